"""Document-grounded conversations as Spark DataFrames."""
