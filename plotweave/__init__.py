"""Spark-native engine for raster line art, vector paths and motion commands."""

__version__ = "0.1.0"
