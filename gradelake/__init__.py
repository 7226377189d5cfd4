"""Collectible-card analytics as Spark DataFrame operations."""
