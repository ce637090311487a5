"""Continuous indexing."""

from .ingest import index_stream

__all__ = ["index_stream"]
