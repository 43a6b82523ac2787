"""impactframe: source-code facts, change impact and training-data operators on Spark DataFrames."""
