"""Shot-level video search and analytics on Spark DataFrames."""
