"""Corpus integrity and measurement analytics on Spark DataFrames."""
