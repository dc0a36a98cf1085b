"""A PySpark-native analytics library for feature layers, rasters and networks."""
