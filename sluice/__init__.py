"""A pipeline query language compiled to Spark DataFrames."""
