"""Analytics on Spark DataFrames: relational queries, streams, and training-data operators."""
