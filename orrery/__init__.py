"""Similarity-driven label transfer, provenance analytics and corpus preparation on PySpark."""
