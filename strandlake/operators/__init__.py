"""Relational operators over sketches, incidence tables, mappings and overlaps."""
