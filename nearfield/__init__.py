"""Vector search and retrieval on Spark DataFrames."""
