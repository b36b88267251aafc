"""Hybrid retrieval and incremental indexing over a catalog, on Spark."""
