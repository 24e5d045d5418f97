"""Retrieval analytics as PySpark jobs: DataFrame in, DataFrame out."""
