"""Interval analytics on Spark DataFrames: overlap joins, sweeps, and set algebra on ranges."""

__version__ = "0.1.0"
