"""Document-conversion analytics on Spark."""
