"""Whole jobs, and the mapping from benchmark tables to mobility frames."""
