"""Network-flow anomaly analytics on Spark DataFrames."""
