"""Column functions; each returns a native Spark column."""
