"""Lineage analytics on Spark."""
