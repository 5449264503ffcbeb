"""Operators on cases: DataFrame in, DataFrame out."""
