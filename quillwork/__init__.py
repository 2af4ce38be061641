"""Spark-first text-retrieval analytics."""
