"""Maritime analytics on Spark DataFrames."""
