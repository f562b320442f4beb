"""Operators of the log-analytics engine."""
