"""Detection analytics on Spark."""
