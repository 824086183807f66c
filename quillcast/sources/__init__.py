"""Scans of landed feeds, pages and metadata, and the tables jobs write."""
