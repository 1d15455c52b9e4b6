"""Kerbside: urban-mobility analytics as plain Spark DataFrame operators."""
