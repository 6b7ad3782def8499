"""Readers and writers of feeds, subscription lists and chapters."""
