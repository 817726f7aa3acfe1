"""Readers and writers of image files."""
