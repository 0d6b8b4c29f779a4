"""Structured Streaming variants of the reports and folds."""
