"""Analytics on Spark DataFrames: relational, temporal and streaming building blocks."""
