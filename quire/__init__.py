"""Document-evidence analytics on Spark."""
