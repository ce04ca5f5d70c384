"""Labour-demand analytics on Spark DataFrames."""
