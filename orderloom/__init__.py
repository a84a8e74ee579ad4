"""orderloom: record resolution, units, change feeds and match analytics on Spark DataFrames."""
