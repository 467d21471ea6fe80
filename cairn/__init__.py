"""Cairn: a retrieval and evaluation engine expressed in Spark DataFrames."""
