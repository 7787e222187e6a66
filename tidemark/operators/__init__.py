"""Version-control operators over DataFrames."""
