"""Log analytics and corpus processing as plain PySpark jobs."""
