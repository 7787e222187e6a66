"""Version-controlled tables on Spark DataFrames."""
