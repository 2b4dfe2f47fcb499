"""displace: ground-motion analytics on Spark DataFrames."""
