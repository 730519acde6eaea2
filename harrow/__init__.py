"""Grouped aggregation over web logs on Spark: sources, strategies, incremental upkeep and reports."""
