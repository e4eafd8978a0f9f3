"""Annotation analytics for large sheets, and corpus preparation, on Spark DataFrames."""
