"""Cohesive communities around query nodes of directed graphs, on Spark DataFrames."""
