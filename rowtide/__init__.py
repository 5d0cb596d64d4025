"""Rowtide: change-feed analytics on Spark DataFrames."""
