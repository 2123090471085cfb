"""Nested-document queries and changes over Spark tables."""
