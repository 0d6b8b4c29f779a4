"""Operators on DataFrames: search, dedupe, merges, reports, calendar, jobs, matching."""
