"""Market-research analytics on Spark DataFrames."""
