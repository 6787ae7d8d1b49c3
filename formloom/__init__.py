"""Form intelligence and entity verification on Spark DataFrames."""
