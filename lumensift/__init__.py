"""Full-text and log search on Spark DataFrames."""
