"""Catalog, delimited text, clustered tables and statistics."""
