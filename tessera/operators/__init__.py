"""DataFrame operators on rasters, candidates, rectangles and layers."""
