"""Columns in, columns out: text, predicates and scores."""
