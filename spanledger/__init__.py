"""Evaluation analytics for tool-using agents, and corpus preparation, on Spark DataFrames."""
