"""Incremental capture."""
