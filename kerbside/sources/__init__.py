"""Batch readers: declared schemas, no inference pass."""
