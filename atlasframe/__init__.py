"""Atlasframe: map data, routing and place search as ordinary Spark DataFrames."""
