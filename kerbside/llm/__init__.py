"""Operators that prepare text and vectors for model training. Nothing else in the library imports this."""
