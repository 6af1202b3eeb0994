"""Analytics over dense volumes as Spark DataFrames."""
