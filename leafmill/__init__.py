"""Document and web-corpus preparation on Spark."""
