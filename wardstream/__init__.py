"""Clinical event and note analytics on Spark DataFrames."""
