"""Patch and mailing-list analytics on Spark DataFrames."""
