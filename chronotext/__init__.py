"""Spark-native analytics over timed text: search, intervals, sequences, merges and planners."""
