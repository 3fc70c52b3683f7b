"""Manuscript conformance analytics on Spark DataFrames."""
