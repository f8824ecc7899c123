"""Public-record risk, data-quality and activity analytics on Spark DataFrames."""
