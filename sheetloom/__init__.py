"""Datasheet-dimension analytics on Spark DataFrames."""
