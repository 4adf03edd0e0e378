"""Catalogue analytics on Spark DataFrames: resolution, search, summaries, streams."""
