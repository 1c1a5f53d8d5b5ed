"""Log and event analytics on Spark DataFrames, in batch and streaming."""
