"""Tables as rasters, rectangles and layers."""
