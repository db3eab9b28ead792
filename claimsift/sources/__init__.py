"""Readers and writers: CSV claim files, stored tables, exports."""
