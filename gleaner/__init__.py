"""Snippet analytics, retrieval and text processing as PySpark DataFrame operators."""
