"""quantloom: option-market analytics on Spark DataFrames."""
