"""Where documents come from, and where indexes are kept."""

from .folders import shared_dir
from .tables import read_documents, read_table

__all__ = ["read_documents", "read_table", "shared_dir"]
