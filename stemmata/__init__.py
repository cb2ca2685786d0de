"""Analytics over collections of versioned documents, on Spark DataFrames."""
