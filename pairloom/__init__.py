"""Mine (function, test) pairs from repository files with PySpark and shape them into tuning records."""
