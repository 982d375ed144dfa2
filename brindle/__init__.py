"""Document search, faceting and corpus preparation on Spark."""
