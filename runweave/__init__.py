"""Sorting, range-partitioning, merging and checking large keyed data on Spark."""
