"""Sources of the log-analytics engine."""
