"""Marketplace pricing analytics on Spark DataFrames."""
