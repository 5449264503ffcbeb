"""Whole questions over the driver tables, put together from the operators."""
