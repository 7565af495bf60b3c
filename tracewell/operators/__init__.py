"""Operators over objects, table edges and column edges."""
