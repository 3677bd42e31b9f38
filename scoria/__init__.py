"""Scoria: analytics over versioned, graph-shaped fact tables, planned with Spark DataFrames."""

__version__ = "0.1.0"
