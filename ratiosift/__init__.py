"""Sparse rational-polynomial discovery under a false-discovery-rate budget, on Spark DataFrames."""
