"""Corpus and discourse analytics on Spark DataFrames."""
