"""Raster tile analytics on Spark."""
