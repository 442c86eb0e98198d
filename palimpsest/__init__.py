"""Transcript cleaning, profiling and dataset building as Spark DataFrame operators."""
