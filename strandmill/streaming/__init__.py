"""Mapping of read streams."""
