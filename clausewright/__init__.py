"""Clause-level catalog search and annotation on Spark DataFrames."""
