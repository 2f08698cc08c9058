"""Incremental forms of chunking and versioning."""
