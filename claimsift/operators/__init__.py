"""DataFrames in, DataFrames out: lookups, features, model, summaries."""
