"""Tessella: composable relational, statistical and provenance operators for PySpark."""
