"""loomline: record processing on Spark DataFrames."""
