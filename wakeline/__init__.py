"""Activity-memory analytics on Spark: capture logs of many users as DataFrames and streams."""
