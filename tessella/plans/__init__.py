"""Queries over the driver's tables."""
