"""Contract-event analytics as Spark DataFrames."""
