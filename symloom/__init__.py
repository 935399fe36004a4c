"""Symbol-graph analytics on Spark."""
