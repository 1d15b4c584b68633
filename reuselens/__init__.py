"""Cache-trace analytics on Spark DataFrames."""
