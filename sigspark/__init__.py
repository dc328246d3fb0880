"""Batch extraction of signal features on Spark DataFrames."""

__version__ = "0.1.0"
