"""Analytics on link graphs with Spark DataFrames."""
