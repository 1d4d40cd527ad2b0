"""Entities, relationships and the documents they come from, as Spark DataFrames."""
