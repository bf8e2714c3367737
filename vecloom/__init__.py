"""Vector search and embedding analytics on Spark DataFrames."""
