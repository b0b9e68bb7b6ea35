"""Sequence and pore-model readers, result writers."""
