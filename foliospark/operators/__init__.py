"""DataFrame operators: selection, merge, reconcile, profile, quality, raster."""
