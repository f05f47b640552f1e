"""Forum posts to daily cross-sectional signals, and the data work around them, as Spark DataFrames."""
