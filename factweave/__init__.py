"""factweave: cited, bitemporal site analytics on Spark DataFrames."""
