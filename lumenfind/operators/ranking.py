"""Retrieval ranked by which terms are present.

With operands sorted by rising weight, bit i standing for operand i, a document ranks by the number whose bits are the
operands that it lacks: holding the heaviest outweighs all lighter ones together. Ties rank by document id. Only
numbers below a cut-off count: the least number at which the operands still asked for weigh less than 1 % of all.
The cut-off is found greedily from the heaviest bit, in one pass. No score is computed beyond that.

The number is given as ``step``, its binary digits from the heaviest operand to the lightest, one for each: texts of a query order
as numbers do, however many operands it has. Bits are gathered in words of a long.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .query import Operand, Query, operands, resolve

if TYPE_CHECKING:
    from .index import DocumentIndex, Term

RELEVANT = 0.01
#: Bits in a word.
WORD = 62
#: Results up to this many are fetched when a limit asks for them, so that ranks and external ids cost no further shuffle.
FETCHED = 10_000


def cut_off(weights: list[float]) -> int:
    """The least number c of which the operands whose bits are 0 in c weigh less than 1 % of all; weights rise with the bit."""
    least = RELEVANT * sum(weights)
    c, active = 0, 0.0
    for i in range(len(weights) - 1, -1, -1):
        if active + weights[i] < least:
            active += weights[i]
        else:
            c |= 1 << i
    return c


def all_of(index: DocumentIndex, terms: list[Term], start: int | None = None, limit: int | None = None) -> DataFrame:
    """Documents that hold all ``(field, term)`` pairs, by id; from id ``start`` on, the first ``limit``. No pair, no document."""
    if not terms:
        return index.postings().select("doc_id").limit(0)
    hit = index.hits(terms)
    if start is not None:
        hit = hit.where(F.col("doc_id") >= start)
    if len(set(terms)) == 1:
        out = hit.select("doc_id")
    else:
        # Postings are a set, so that counting them counts distinct terms.
        out = hit.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == len(set(terms))).select("doc_id")
    return out.orderBy("doc_id").limit(limit) if limit is not None else out


def _passing(index: DocumentIndex, hits: DataFrame, filters: list[Term]) -> DataFrame:
    for f in dict.fromkeys(filters):
        hits = hits.join(index.hits([f]).select("doc_id"), "doc_id", "left_semi")
    return hits


def _digits(held: list[Column], n: Column) -> Column:
    """The ``n`` binary digits of the operands that words of held bits lack, the highest word first."""
    parts = []
    for j in reversed(range(len(held))):
        size = F.least(F.lit(WORD), n - WORD * j).cast("int")
        full = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(size, F.lit(0))) - 1
        digits = F.lpad(F.bin(full.bitwiseAND(F.bitwise_not(held[j]))), size, F.lit("0"))
        parts.append(F.when(size > 0, digits).otherwise(""))
    return F.concat(*parts)


def rank(index: DocumentIndex, ops: list[Operand], filters: list[Term]) -> DataFrame:
    """``(doc_id, step)`` of all results, unordered."""
    if not ops and not filters:
        return index.spark.createDataFrame([], "doc_id long, step string")
    if not ops:
        return all_of(index, filters).select("doc_id", F.lit("").alias("step"))
    hits = _passing(index, index.hits([(o.field, o.term) for o in ops]), filters)
    masks: dict[Term, int] = {}
    for o in ops:
        masks[o.field, o.term] = masks.get((o.field, o.term), 0) | 1 << o.bit
    words = range(-(-len(ops) // WORD))
    cut = format(cut_off([o.weight for o in ops]), f"0{len(ops)}b")
    if len(masks) <= WORD:
        word = [F.coalesce(*(F.when((F.col("field") == f) & (F.col("key") == t), F.lit(m >> WORD * j & (1 << WORD) - 1).cast("long")) for (f, t), m in masks.items())) for j in words]
    else:
        rows = [(f, t, *(m >> WORD * j & (1 << WORD) - 1 for j in words)) for (f, t), m in masks.items()]
        table = index.spark.createDataFrame(rows, "field string, key string, " + ", ".join(f"w{j} long" for j in words))
        hits = hits.join(F.broadcast(table), ["field", "key"])  # as many rows as the query has words
        word = [F.col(f"w{j}") for j in words]
    held = hits.groupBy("doc_id").agg(*(F.bit_or(w).alias(f"held{j}") for j, w in zip(words, word)))
    return held.select("doc_id", _digits([F.col(f"held{j}") for j in words], F.lit(len(ops))).alias("step")).where(F.col("step") < cut)


def run_query(index: DocumentIndex, query: Query | str, limit: int | None = None) -> DataFrame:
    """Results ``(doc_id, step)`` in rank order, the first ``limit`` with their ``rank``; ``ext_id`` is added if the index has external ids.

    A limit up to FETCHED runs at once, and what is returned is its rows; all else runs when it is asked for."""
    query = Query(query) if isinstance(query, str) else query
    ops, filters = resolve(index, query)
    out = rank(index, ops, filters) if filters is not None else rank(index, [], [])
    known = None
    if limit is not None:
        out = out.orderBy("step", "doc_id").limit(limit)
        if limit <= FETCHED:
            rows = out.collect()
            known = [r.doc_id for r in rows]
            out = index.spark.createDataFrame([(*r, n) for n, r in enumerate(rows, 1)], "doc_id long, step string, rank int").coalesce(1)
        else:
            # Only the limit's rows reach the window.
            out = out.withColumn("rank", F.row_number().over(Window.orderBy("step", "doc_id")))
    if index.external_ids is not None:
        out = index.with_external_ids(out, known)
    return out.orderBy("step", "doc_id")


def batch_operands(index: DocumentIndex, queries: DataFrame) -> DataFrame:
    """``(query_id, field, term, df, weight, bit)`` of many queries."""
    order = Window.partitionBy("query_id").orderBy("weight", "op_order")
    return operands(index, queries).withColumn("bit", F.row_number().over(order) - 1).drop("op_order")


def batch_cuts(ops: DataFrame) -> DataFrame:
    """``(query_id, n, cut)``: each query's number of operands and its cut-off, as digits."""
    falling = F.reverse(F.array_sort(F.collect_list(F.struct("bit", "weight"))))
    per = ops.groupBy("query_id").agg(falling.alias("ops"), F.count("*").cast("int").alias("n"))
    total = F.aggregate("ops", F.lit(0.0), lambda a, o: a + o["weight"])
    per = per.withColumn("least", total * RELEVANT)
    start = F.struct(F.lit(0.0).alias("active"), F.lit("").alias("key"))

    def take(a: Column, o: Column) -> Column:
        fits = a["active"] + o["weight"] < F.col("least")
        return F.struct(F.when(fits, a["active"] + o["weight"]).otherwise(a["active"]).alias("active"), F.concat(a["key"], F.when(fits, "0").otherwise("1")).alias("key"))

    return per.select("query_id", "n", F.aggregate("ops", start, take)["key"].alias("cut"))


def _leading(ops: DataFrame, limit: int) -> DataFrame:
    """Of each query the heaviest operands, as far as the first one that ``limit`` documents hold. Who holds none of these ranks after all who hold
    any, and of those there are enough: the first ``limit`` results are among the postings of these operands."""
    heavier = Window.partitionBy("query_id").orderBy(F.desc("bit")).rowsBetween(Window.unboundedPreceding, -1)
    return ops.withColumn("most", F.max("df").over(heavier)).where(F.col("most").isNull() | (F.col("most") < limit)).drop("most")


def run_queries(index: DocumentIndex, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """``(query_id, doc_id, step, rank)`` of many queries ``(query_id, text)`` at once, the first ``limit`` results of each.

    All stays distributed: operands meet postings in joins by field and term, which Spark broadcasts or, if there are too
    many, shuffles, splitting frequent terms; then one aggregation by query and document gathers bits. With a limit, only documents that hold
    a leading operand go into it. The operands themselves, a row a word of the queries, are computed once; only their greatest number reaches the driver.
    """
    ops = batch_operands(index, queries).persist()
    n = (ops.agg(F.max("bit")).first()[0] or 0) + 1
    words = range(-(-n // WORD))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(WORD)).cast("int"))
    masks = ops.groupBy("query_id", "field", F.col("term").alias("key")).agg(*(F.coalesce(F.bit_or(F.when(F.floor(F.col("bit") / WORD) == j, bit)), F.lit(0).cast("long")).alias(f"w{j}") for j in words))
    if limit is None:
        hits = index.matching("postings", masks)
    else:
        leading = _leading(ops, limit).select("query_id", "field", F.col("term").alias("key")).distinct()
        candidates = index.matching("postings", leading).select("query_id", "doc_id").distinct()
        # Each posting of the queries' terms once, however many queries ask for it; it meets candidates by term and document.
        asked = index.matching("postings", masks.select("field", "key").distinct())
        hits = candidates.join(masks, "query_id").join(asked, ["field", "key", "doc_id"])
    held = hits.groupBy("query_id", "doc_id").agg(*(F.bit_or(f"w{j}").alias(f"w{j}") for j in words))
    out = held.join(batch_cuts(ops), "query_id").select("query_id", "doc_id", _digits([F.col(f"w{j}") for j in words], F.col("n")).alias("step"), "cut")
    out = out.where("step < cut").drop("cut").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("step", "doc_id")))
    return out.where(F.col("rank") <= limit) if limit is not None else out
