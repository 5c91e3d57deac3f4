"""Label index and selector engine for time series on Spark DataFrames."""
