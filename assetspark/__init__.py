"""Analytics over packed binary asset libraries, expressed as Spark DataFrames."""
