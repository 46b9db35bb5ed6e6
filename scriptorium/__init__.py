"""scriptorium: text and vector retrieval on Spark DataFrames."""
