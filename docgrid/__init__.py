"""Recognized text fragments to clean, reconciled records, as Spark DataFrame operations."""
