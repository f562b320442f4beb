"""Plans of the log-analytics engine."""
