"""Customer-support conversation analytics on Spark DataFrames."""
