"""Behavioural drift analysis of logged interactions, expressed as Spark DataFrames."""

__version__ = "0.1.0"
