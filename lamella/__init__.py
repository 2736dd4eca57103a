"""Slide analytics on Spark: tile grids, pyramids, stores and pixels as DataFrames."""
