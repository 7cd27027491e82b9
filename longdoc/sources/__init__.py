"""Readers and writers (A1-A10) and the mapping of the driver tables."""
