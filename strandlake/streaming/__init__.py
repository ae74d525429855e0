"""Sketch sets that grow with a stream of sequences."""
