"""Column functions: text, JSON and redaction."""
