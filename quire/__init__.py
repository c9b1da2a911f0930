"""Document-library analytics on Spark DataFrames."""
