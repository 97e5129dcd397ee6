"""Document-data analytics on Spark."""
