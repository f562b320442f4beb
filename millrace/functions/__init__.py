"""Functions of the log-analytics engine."""
