"""Operators over DataFrames: intervals, sequences, merges of records, rankings, folds, vectors."""
