"""Column functions: text, URLs and times."""
