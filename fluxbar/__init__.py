"""fluxbar: analytics for ordered market and event data on Spark DataFrames."""
