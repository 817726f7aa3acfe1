"""Incremental ingest of image files."""
