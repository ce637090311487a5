"""Queries and their operands."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import Term, term_key

if TYPE_CHECKING:
    from .index import DocumentIndex


class ChainingOperator(Enum):
    """How a filter restricts; only MUST is defined."""

    MUST = "must"
    MAY = "may"
    MUST_NOT = "must_not"


@dataclass(frozen=True)
class Query:
    """A query's text and the filters that all results must pass. A filter on a term that its field doesn't
    hold is left out of account, unless ``strict_filters`` is set: then nothing passes it."""

    text: str
    filters: tuple[tuple[str, object], ...] = ()
    strict_filters: bool = False

    def filter_by(self, field: str, term: object, how: ChainingOperator = ChainingOperator.MUST) -> Query:
        if how is not ChainingOperator.MUST:
            raise NotImplementedError(f"filters of kind {how.value} aren't defined")
        return replace(self, filters=(*self.filters, (field, term)))


@dataclass(frozen=True)
class Operand:
    """A weighted term of a query in one field; ``bit`` is its rank by weight, the lightest being 0."""

    bit: int
    field: str
    term: str
    weight: float

    def __str__(self) -> str:
        return f'Querying term "{self.term}" on field "{self.field}" with weight Weight({self.weight})'


def _tokens(index: DocumentIndex, queries: DataFrame) -> DataFrame:
    """``(query_id, op_order, field, key)``: each token in each field that its target names."""
    texts = queries.select("query_id", F.col("text").alias("token"))
    pipeline = index.query_pipeline
    tokens = pipeline.apply(texts) if hasattr(pipeline, "apply") else pipeline(texts)
    of_target = {t: [f.name for f in index.schema.members(t)] for t in index.schema.targets()}
    fields = F.coalesce(*(F.when(F.col("target") == t, F.array(*map(F.lit, fs))) for t, fs in of_target.items() if fs), F.array().cast("array<string>"))
    return tokens.withColumn("field", F.explode(fields)).select("query_id", F.struct("branch", "pos", "field").alias("op_order"), "field", term_key().alias("key"))


def operands(index: DocumentIndex, queries: DataFrame) -> DataFrame:
    """``(query_id, op_order, field, term, df, weight)`` of queries ``(query_id, text)``: each token in each field
    that knows it. Repeated tokens stay; unknown ones and weights that aren't positive drop out. ``op_order`` is the
    order of creation: branches first, then by position, then by field name.
    """
    found = index.matching("dictionary", _tokens(index, queries)).groupBy("query_id", "op_order", "field", "key").agg(F.sum("df").alias("df"))
    return index.weighted(found).where("weight > 0 AND NOT isnan(weight)").select("query_id", "op_order", "field", F.col("key").alias("term"), "df", "weight")


def resolve(index: DocumentIndex, query: Query) -> tuple[list[Operand], list[Term] | None]:
    """A query's operands, by rising weight (of equal weights the later one has the higher bit), and its known filters, or None if nothing can pass.

    One query is a few words: they are looked up as constants, which opens their buckets of the dictionary alone."""
    tokens = _tokens(index, index.spark.createDataFrame([(0, query.text)], "query_id long, text string")).collect()
    filters = [(f, str(t)) for f, t in query.filters]
    terms = list(dict.fromkeys([*((r.field, r.key) for r in tokens), *filters]))
    index.look_up(terms)
    known = {(r.field, r.k): r.weight for r in index.dictionary(terms=terms).select("field", term_key().alias("k"), "weight").collect()} if terms else {}
    found = [(w, list(r.op_order), r.field, r.key) for r in tokens if (w := known.get((r.field, r.key))) is not None and w > 0]  # NaN isn't, either
    ops = [Operand(bit, f, t, w) for bit, (w, _, f, t) in enumerate(sorted(found, key=lambda x: x[:2]))]
    if query.strict_filters and any(f not in known for f in filters):
        return ops, None
    return ops, [f for f in filters if f in known]


def query_operands(index: DocumentIndex, query: Query) -> list[Operand]:
    """The operands of one query, by rising weight."""
    return resolve(index, query)[0]


def explain(index: DocumentIndex, query: Query | str) -> DataFrame:
    """``(bit, field, term, weight, description)`` of a query's operands."""
    query = Query(query) if isinstance(query, str) else query
    rows = [(o.bit, o.field, o.term, o.weight, str(o)) for o in query_operands(index, query)]
    return index.spark.createDataFrame(rows, "bit int, field string, term string, weight double, description string")
