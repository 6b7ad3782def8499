"""Whole tasks: transcript search, and the planners that decide what to fetch, transcribe, keep and drop."""
