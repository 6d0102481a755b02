"""Label and text analytics on Spark DataFrames."""
