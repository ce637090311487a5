"""Hierarchies: ordered forests of terms, as edge tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES = "ord long, term string, parent string"


class Hierarchy:
    """Terms with at most one parent each, in the order in which they were added."""

    def __init__(self, spark: SparkSession, edges: DataFrame | None = None):
        self.spark = spark
        self._edges = edges
        self._new: list[tuple[int, str, str | None]] = []
        self._known: set[str] = set()

    def add_element(self, term: str, parent: str | None = None) -> None:
        """A root, or a child of a term that is there already; ValueError if the term is there or the parent isn't."""
        if self._edges is not None:
            raise ValueError("a hierarchy of a table takes no more elements")
        if term in self._known:
            raise ValueError(f"{term!r} is in the hierarchy already")
        if parent is not None and parent not in self._known:
            raise ValueError(f"the parent {parent!r} of {term!r} isn't in the hierarchy")
        self._known.add(term)
        self._new.append((len(self._new), term, parent))

    @classmethod
    def of(cls, spark: SparkSession, elements: Iterable[tuple[str, str | None]]) -> Hierarchy:
        out = cls(spark)
        for term, parent in elements:
            out.add_element(term, parent)
        return out

    @classmethod
    def from_table(cls, edges: DataFrame) -> Hierarchy:
        """Of a table ``(ord, term, parent)``, held to the same rules in one pass over it; ValueError if it breaks one."""
        edges = edges.select(F.col("ord").cast("long").alias("ord"), "term", "parent")
        parents = edges.select(F.col("term").alias("parent"), F.col("ord").alias("p_ord"))
        first = edges.groupBy("term").count().where("count > 1 OR term IS NULL").select("term", F.lit("is there twice").alias("why"))
        late = edges.where("parent IS NOT NULL").join(parents, "parent", "left").where("p_ord IS NULL OR p_ord >= ord").select("term", F.lit("comes before its parent, or has none").alias("why"))
        if bad := first.union(late).limit(1).collect():
            raise ValueError(f"{bad[0].term!r} {bad[0].why}")
        return cls(edges.sparkSession, edges)

    @property
    def edges(self) -> DataFrame:
        return self._edges if self._edges is not None else self.spark.createDataFrame(self._new, EDGES)

    def get_root_terms(self) -> DataFrame:
        """``(ord, term)`` of the roots, in order."""
        return self.edges.where("parent IS NULL").select("ord", "term").orderBy("ord")

    def get_child_terms(self, term: str) -> DataFrame | None:
        """``(ord, term)`` of a term's children, in order: empty for a leaf, None for an unknown term."""
        if self.edges.where(F.col("term") == term).isEmpty():
            return None
        return self.edges.where(F.col("parent") == term).select("ord", "term").orderBy("ord")
