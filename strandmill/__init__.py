"""Sequence mapping and raw-signal processing as Spark jobs."""
