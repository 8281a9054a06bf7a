"""Readers of the files that come with the data."""
