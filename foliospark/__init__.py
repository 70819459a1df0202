"""Corpus building, auditing and stress-testing on Spark DataFrames."""
