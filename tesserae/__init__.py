"""Tesserae: image analytics on Spark, with an optional subpackage of text operators."""
