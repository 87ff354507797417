"""Scans and sinks: pixel cubes, rasters, catalogues, stores and fixed dimensions."""
