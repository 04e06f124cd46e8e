"""tidemark: a versioned, ordered key-value engine expressed as Spark DataFrames."""
