"""Operators on relations of images."""
