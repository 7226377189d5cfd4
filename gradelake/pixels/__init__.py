"""Rasters: a relational form, one row per pixel, and numpy kernels, one row per image."""
