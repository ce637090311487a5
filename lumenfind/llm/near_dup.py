"""Near-duplicate groups by bottom-k sketches of one hash function.

A document's sketch is the k least hashes of its word n-grams. Inverted lists of retained values bring
together documents whose sketches overlap; the least k values of the union of two sketches estimate their
Jaccard similarity; pairs that pass the estimate are verified by the exact Jaccard similarity of their
n-gram sets; verified pairs and exact copies form the groups.

Long lists are handled exactly, without a cap, in two ways. A document enters lists of its rarest values only, as many as
a pair that passes the estimate must share one of (see :func:`list_masks`): boilerplate that thousands of documents share, and that
alone wouldn't make them pass, is never expanded, and a document whose values nobody else has enters no list.
And a list need not give all its pairs: first each document meets the best leader of its lists, which joins a group of
thousands of copies in about as many pairs; then only pairs of documents that are still in
different groups follow. Pairs within a group can't change the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vec
from .store import Scratch, connected_components, own_key, unused


def shingle_sets(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row in rising order, and the first of each row's."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, row))
    h, row = hashes[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[fresh], np.concatenate([[0], np.cumsum(np.bincount(row[fresh], minlength=len(first) - 1))])


def _sketches(docs: DataFrame, k: int, n: int, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, print, sketch)``: a 128-bit fingerprint of the text, and its sketch in rising order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in vec.slices(vec.as_strings(batch.column(1))):
                part = batch.slice(a, b - a)
                w = vec.words(part.column(1))
                h, first = shingle_sets(*vec.kgrams(w.hash, w.first, n, whole=True))
                within = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
                ends = np.concatenate([[0], np.cumsum(np.minimum(np.diff(first), k))])
                prints = [xxhash.xxh3_128_digest(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(prints, pa.binary()), vec.lists(h[within < k].view(np.int64), ends, pa.int64())], names=["doc_id", "print", "sketch"]
                )

    some = docs.where(F.col(doc_id).isNotNull() & (F.col(text) != ""))
    return some.select(doc_id, text).mapInArrow(run, f"doc_id {_kind(docs, doc_id)}, print binary, sketch array<long>")


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


#: Ids of listed documents up to this many bytes are sent to the tasks.
SENT_BYTES = 64 << 20


def _sets(docs: DataFrame, n: int, listed: Broadcast | None = None) -> DataFrame:
    """``(doc, grams)`` with all distinct n-gram hashes of each text, in rising order; with ``listed``, hashes of ids in rising order, only of
    documents with one of these (and of a few more if hashes agree)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if listed is not None and batch.num_rows:
                h, known = batch.column(2).to_numpy(), listed.value
                batch = batch.filter(pa.array(np.searchsorted(known, h, side="right") > np.searchsorted(known, h, side="left")))
            for a, b in vec.slices(vec.as_strings(batch.column(1))):
                part = batch.slice(a, b - a)
                w = vec.words(part.column(1))
                h, first = shingle_sets(*vec.kgrams(w.hash, w.first, n, whole=True))
                yield pa.RecordBatch.from_arrays([part.column(0), vec.lists(h.view(np.int64), first, pa.int64())], names=["doc", "grams"])

    return docs.select("doc", "text", F.xxhash64("doc")).mapInArrow(run, f"doc {_kind(docs, 'doc')}, grams array<long>")


#: Sizes that share a list of a value.
LEVEL = 8


def list_masks(at: np.ndarray, first: np.ndarray, size: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """In which lists documents enter their shared values: two boolean tables, of a row a value and a column a size 1 to k.

    ``at`` are the places (from 1) of each document's shared values in its sketch, the rarest value first (by the number of documents that
    retain it, then by value); values that it alone has are rarer than all. ``first`` parts documents, ``size`` is the length of each value's sketch.

    Let T be the greatest of the k least values of the union of two sketches, a and b the number of values up to T in either, o the
    number that they share: a + b - o is k, or the whole union if that is smaller, and the estimate passes if o >= least (a + b - o). Let
    a >= b. The rarest shared value has at most a - o values before it among the first a of the one, and at most b - o among the
    first b of the other. So if the first table marks a value at size a as one that document may share as the *larger* side of a pair, and the second
    as one that it may share as the *smaller* side of such a pair, for any b that goes with a, then every pair that passes
    meets at some value and size. In documents of like size that share boilerplate of half their words or less, it doesn't.
    """
    n, count = len(at), np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    large, small = np.zeros((n, k), bool), np.zeros((n, k), bool)
    need = int(np.ceil(least * k - 1e-9))
    # k values in the union: a + b >= k + need, so a is half of that at least, and b need at least.
    at, s = at.astype(np.int16)[:, None], size.astype(np.int16)[:, None]
    cols = np.arange(need, k + 1, dtype=np.int16)
    within = at <= cols
    total = np.zeros((n + 1, len(cols)), np.int16)
    np.cumsum(within, axis=0, dtype=np.int16, out=total[1:])  # differences are small, whatever wraps
    # The rank by rarity among a document's first a values, itself included; it rises with a.
    rank = total[1:] - (total[first[1:]])[row] + cols
    low = -(-(k + need) // 2)
    a = cols[low - need :]
    large[:, low - 1 :] = within[:, low - need :] & (a <= s) & (rank[:, low - need :] <= a - need + 1)
    own = np.take_along_axis(rank, np.maximum(at - need, 0).astype(np.int64), 1)
    least_b = k + need - a
    at_b = np.where(at <= least_b, rank[:, least_b - need], own)
    small[:, low - 1 :] = within[:, low - need :] & (least_b <= s) & (at_b <= k - a + 1)
    # Two whole sets of fewer than k values together: all of a set are its first ones.
    if len(short := np.flatnonzero(size < k)):
        s, a = size[short].astype(np.int64)[:, None], np.arange(1, k + 1)
        whole = s - (count[row] - (np.arange(n) - first[row]) - 1)[short, None]
        large[short] |= (a == s) & (whole <= s - np.ceil(least * s - 1e-9) + 1)
        small[short] |= (a >= s) & (a < k) & (least * a <= s + 1e-9) & (whole <= s - np.ceil(least / (1 + least) * (a + s) - 1e-9) + 1)
    return large, small


def _entries(shared: DataFrame, k: int, least: float) -> DataFrame:
    """``(doc, value, level, large, small)``: the lists that each document enters, with the sizes, as bits, at which it is the larger or smaller side.

    ``shared`` has ``(doc, size, at, value, freq)``. An id with several texts has the values of several sketches: each ranks before no more of the others
    than it does in its own, so that it enters every list that it would enter for one text. An id with very many is
    taken in parts, and enters all their lists, on either side at every size."""

    def bits(table: np.ndarray) -> np.ndarray:
        full = np.zeros((len(table), -(-k // LEVEL) * LEVEL), bool)
        full[:, :k] = table
        return (full.reshape(len(table), -1, LEVEL) << np.arange(LEVEL)).sum(2)

    def entries(rows: pa.Table, part: bool) -> pa.RecordBatch:
        """Of whole documents in order; the first is ``part`` of one with very many values."""
        docs, size, at, value = rows.column(0).combine_chunks(), *(rows.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3))
        new = np.ones(len(at), bool)
        new[1:] = pc.not_equal(docs[1:], docs[:-1]).to_numpy(zero_copy_only=False)
        row = np.cumsum(new) - 1
        fresh = new.copy()
        fresh[1:] |= (value[1:] != value[:-1]) | (at[1:] != at[:-1]) | (size[1:] != size[:-1])
        docs, size, at, value, row = docs.filter(pa.array(fresh)), size[fresh], at[fresh], value[fresh], row[fresh]
        first = np.concatenate([[0], np.cumsum(np.bincount(row))])
        large, small = list_masks(at, first, size, k, least)
        if part:
            large[: first[1]] = small[: first[1]] = True
        large, small = bits(large), bits(small)
        i, level = np.nonzero(large | small)
        return pa.RecordBatch.from_arrays(
            [docs.take(pa.array(i)), pa.array(value[i]), pa.array(level, pa.int16()), pa.array(large[i, level], pa.int16()), pa.array(small[i, level], pa.int16())],
            names=["doc", "value", "level", "large", "small"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, known = None, None  # ``known``: a document of which parts have gone before
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]) if rest is not None else rows
            docs = rows.column(0)
            part = known is not None and known.equals(docs[0])
            same = pc.equal(docs, docs[-1]).to_numpy()
            cut = len(same) - int(same.sum())
            # All but the last document are whole.
            if cut:
                yield entries(rows.slice(0, cut), part)
                known = None
            rest = rows.slice(cut)
            if known is not None or len(rest) > 32 * k:
                yield entries(rest, True)
                rest, known = None, docs[-1]
        if rest is not None:
            yield entries(rest, False)

    rows = shared.select("doc", "size", "at", "value", "freq").repartition("doc").sortWithinPartitions("doc", "freq", "value", "at", "size")
    return rows.select("doc", "size", "at", "value").mapInArrow(run, f"doc {_kind(shared, 'doc')}, value long, level short, large short, small short")


def _passing(pairs: DataFrame, table: DataFrame, column: str, least: float, k: int | None) -> DataFrame:
    """The pairs ``(a, b)`` whose rising arrays in ``table`` have at least that Jaccard similarity: of the
    least ``k`` values of their union, or of all values where ``k`` is None."""
    left = table.select(F.col("doc").alias("a"), F.col(column).alias("x"))
    right = table.select(F.col("doc").alias("b"), F.col(column).alias("y"))
    kind = _kind(table, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(vec.rows(batch.column(2)), vec.rows(batch.column(3))):
                both = np.concatenate([x, y])
                if k is not None:  # sketches hold the least values as unsigned numbers
                    both = both.view(np.uint64)
                both.sort()
                twice = both[1:] == both[:-1]
                fresh = np.concatenate([[True], ~twice])
                union = int(fresh.sum())
                if k is None or union <= k:
                    keep.append(int(twice.sum()) >= least * union - 1e-9)
                else:
                    last = both[fresh][k - 1]
                    keep.append(int((twice & (both[1:] <= last)).sum()) >= least * k - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, threshold: float = 0.55, n: int = 3, k: int = 64, slack: float = 0.15, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, group_id)`` of every document that has a copy or a near copy; group_id is the group's least doc_id.

    Documents are near copies if the sets of their word n-grams have a Jaccard similarity of at least ``threshold``;
    groups are what such pairs connect. Candidates are pairs of which the sketches estimate ``threshold - slack`` or
    more: the estimate's standard deviation is at most 0.5 / sqrt(k), so slack 0.15 at k = 64 passes over 98 of 100
    pairs just at the threshold, and nearly all above.

    Ids may be of any type that has an order, text included. Two equal non-empty texts are always copies, with or without words. Null and empty texts and null ids
    are in no group. Texts of fewer than n words have one n-gram, of all their words. A repeated row (the same id and
    text) isn't a copy of itself. If one id has several texts, each counts, so they are in one group by
    their id. Ties make groups as any other pair does; very long texts are taken whole; an empty table gives
    an empty result; other columns are never read.
    """
    s = Scratch(docs.sparkSession, "near")
    least = threshold - slack
    sketches = s.keep(_sketches(docs, k, n, doc_id, text), "sketches")
    # Exact copies: the one with the least id stands for all. Another text of a copy's id stays.
    copies = s.keep(
        sketches.select("doc_id", "print").withColumn("doc", F.min("doc_id").over(Window.partitionBy("print"))).where("doc_id <> doc").distinct(), "copies"
    )
    base = sketches.where(F.size("sketch") > 0)

    # Inverted lists. A value that one document alone retains makes none, but comes first in the order by
    # frequency, so it takes the place of others. A document's shared values are k at most.
    one = base.join(copies.select("doc_id", "print"), ["doc_id", "print"], "left_anti").select(F.col("doc_id").alias("doc"), "sketch")
    places = one.select("doc", F.size("sketch").cast("short").alias("size"), F.posexplode("sketch").alias("at", "value"))
    retained = places.withColumn("freq", F.count("*").over(Window.partitionBy("value"))).where("freq > 1").withColumn("at", (F.col("at") + 1).cast("short"))
    # A list in which none is the larger side, or none the smaller, has no pair to give.
    of_list = Window.partitionBy("value", "level")
    lists = _entries(retained, k, least).withColumn("leader", F.min("doc").over(of_list))
    lists = lists.withColumn("larger", F.max("large").over(of_list)).withColumn("smaller", F.max("small").over(of_list)).where("larger > 0 AND smaller > 0")
    lists = s.keep(lists.drop("larger", "smaller"), "lists")

    # First round: each document and the leader that most of its lists have, of ties the least.
    votes = lists.where("doc <> leader").groupBy("doc", "leader").agg((-F.count("*")).alias("n"))
    best = votes.groupBy("doc").agg(F.min(F.struct("n", "leader")).alias("x"))
    first = best.select(F.col("doc").alias("a"), F.col("x.leader").alias("b"))
    small = one.select("doc", "sketch")
    passing = s.keep(_passing(first, small, "sketch", least, k), "first")
    # N-gram sets of the documents in lists: all that verification can ever need. While their ids fit SENT_BYTES they go to the tasks that read
    # the texts, so that no text is shuffled; else texts and ids meet in a join.
    texts = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    listed = s.keep(lists.select("doc").distinct(), "listed")
    if 8 * listed.count() <= SENT_BYTES:
        sent = listed.select(F.xxhash64("doc").alias("h")).toArrow().column(0).to_numpy()
        grams = _sets(texts, n, docs.sparkSession.sparkContext.broadcast(np.sort(sent.astype(np.int64))))
    else:
        grams = _sets(texts.join(listed, "doc", "left_semi"), n)
    grams = s.keep(grams, "grams")
    verified = s.keep(_passing(passing, grams, "grams", threshold, None), "verified-1")
    roots = s.keep(connected_components(verified, s), "roots")

    # Second round: the larger and the smaller sides that lists hold of different groups. The list's largest group meets the others but not itself.
    grouped = lists.drop("leader").join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    mixed = grouped.withColumn("lo", F.min("root").over(of_list)).withColumn("hi", F.max("root").over(of_list)).where("lo <> hi").drop("lo", "hi")
    mixed = mixed.withColumn("n", F.count("*").over(Window.partitionBy("value", "level", "root")))
    mixed = s.keep(mixed.withColumn("main", F.max(F.struct("n", "root")).over(of_list)["root"] == F.col("root")).drop("n"), "mixed")
    x = mixed.where("large <> 0").select("value", "level", F.when(F.col("main"), 1).otherwise(0).alias("meets"), F.col("doc").alias("p"), F.col("root").alias("p_root"), "large")
    meets = F.explode(F.when(F.col("main"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))
    y = mixed.where("small <> 0").select("value", "level", meets.alias("meets"), F.col("doc").alias("q"), F.col("root").alias("q_root"), "small")
    across = x.join(y, ["value", "level", "meets"]).where(F.col("p_root") != F.col("q_root")).where(F.col("large").bitwiseAND(F.col("small")) != 0)
    across = across.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    passing = s.keep(_passing(across, small, "sketch", least, k), "second")
    more = s.keep(_passing(passing, grams, "grams", threshold, None), "verified-2")

    edges = verified.union(more).union(copies.select(F.col("doc_id").alias("a"), F.col("doc").alias("b")))
    out = s.keep(connected_components(edges, s, "all").select(F.col("node").alias("doc_id"), F.col("root").alias("group_id")), "groups")
    s.drop("sketches", "copies", "lists", "listed", "first", "second", "grams", "verified-1", "verified-2", "roots", "mixed")
    return out


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """``docs`` with one document of each group of :func:`near_duplicates`, that of the least id; of rows that repeat
    an id the one of least text stays. A row without an id goes by a fingerprint of its text, so copies of it go and it goes if
    it copies a row with an id; rows with neither id nor text, and documents in no group, stay as they are.

    The join and the window share a partitioning by key, so texts are shuffled once."""
    key, gone, row = unused(docs, "copy_key"), unused(docs, "gone"), unused(docs, "row")
    docs = docs.withColumn(key, own_key(docs, doc_id, text))
    groups = near_duplicates(docs, doc_id=key, text=text, **params)
    kept = docs.join(groups.where("doc_id <> group_id").select(F.col("doc_id").alias(gone)).distinct(), F.col(key) == F.col(gone), "left_anti")
    # Different texts without an id don't stand for each other, even if their keys were equal.
    first = F.row_number().over(Window.partitionBy(key, F.when(F.col(doc_id).isNull(), F.col(text))).orderBy(F.col(text).asc_nulls_last()))
    nothing = F.col(doc_id).isNull() & (F.coalesce(F.col(text), F.lit("")) == "")
    return kept.withColumn(row, first).where((F.col(row) == 1) | nothing).drop(row, key)
