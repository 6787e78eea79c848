"""Mesh data and analytics on Spark DataFrames."""
