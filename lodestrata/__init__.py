"""Deductive analytics and incremental views on Spark DataFrames."""
