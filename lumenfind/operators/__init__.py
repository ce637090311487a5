"""Stages, the index, queries, ranking, facets, hierarchies."""
