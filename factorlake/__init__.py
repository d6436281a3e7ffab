"""Mixture analytics for vector collections, on Spark DataFrames."""
