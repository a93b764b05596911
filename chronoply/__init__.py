"""Event sequences and board graphs on Spark DataFrames."""
