"""Streaming of the log-analytics engine."""
