"""Operators for building language-model training data (ten stand-alone Spark jobs)."""
