"""polyview: multi-view object observations and point tables on Spark DataFrames."""
