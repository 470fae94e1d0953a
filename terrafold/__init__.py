"""terrafold: spatial-temporal analytics on PySpark DataFrames."""
