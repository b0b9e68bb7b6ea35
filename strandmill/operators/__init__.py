"""Index, search and signal operators."""
