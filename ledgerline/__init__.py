"""Company-registry analytics on Spark DataFrames."""
