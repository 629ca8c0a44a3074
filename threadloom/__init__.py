"""Narrative networks of text corpora, computed by Spark."""
