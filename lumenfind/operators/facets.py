"""Facets: a field's terms by falling document frequency."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Supplement
from .index import term_key

if TYPE_CHECKING:
    from .index import DocumentIndex


def frequent_terms(index: DocumentIndex, field: str) -> DataFrame:
    """``(df, term)`` of a field with facets, most frequent first, ties by term; take as many as wanted."""
    f = index.schema.fields[field]
    if f.supplement is not Supplement.FILTER:
        raise ValueError(f"field {field} has no facets")
    # Ties by the term's own order: numbers and dates as such.
    rows = index.dictionary(field).select("df", term_key().alias("term"))
    return rows.orderBy(F.desc("df"), f.decode(F.col("term")))
