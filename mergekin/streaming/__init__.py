"""Incremental arrival of records."""
