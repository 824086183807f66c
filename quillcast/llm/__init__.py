"""Operators of a training-data pipeline: archives, tokens, quality, toxicity and duplicates."""
