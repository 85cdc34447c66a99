"""Fleet and cache analytics for in-memory data stores, on Spark DataFrames."""
