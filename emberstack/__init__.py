"""Sampling-profile analytics on Spark DataFrames."""
