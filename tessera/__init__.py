"""A Spark-native engine for raster and texture collections."""
