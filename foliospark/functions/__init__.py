"""Column functions: digests, text, geometry, statistics."""
