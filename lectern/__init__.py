"""Narrated-text production analytics, written as plain PySpark DataFrame jobs."""
