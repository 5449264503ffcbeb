"""Readers and writers of logs, baselines and runs."""
