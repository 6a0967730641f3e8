"""lodestar: retrieval analytics on Spark DataFrames."""
