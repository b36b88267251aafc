"""Operators over catalogs: search, ranking, statistics, maintenance and indexing."""
