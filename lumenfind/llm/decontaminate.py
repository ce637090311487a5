"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching (Wise, 1993).

Runs of ``match`` words that a document shares with a benchmark item are the seeds; a join brings
them together. Each pair that could reach the threshold is tiled: the longest common runs of
unmarked words are marked first, again and again, down to ``match`` words. As tiles may lie in any
order, a passage whose parts were moved about is covered as well as one that was copied straight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .store import Scratch, own_key, unused

#: Benchmark seeds up to this many bytes are also sent to the tasks, to filter before the join.
SENT_BYTES = 64 << 20


#: Two primes below 2^31: products of residues fit 64 bits, and both residues together tell 62 bits.
_PRIMES = ((2147483647, 1103515245), (2147483629, 1812433253))


class RunningHash:
    """Karp-Rabin hashes of all windows of one text, of any length: a window's hash is that of the prefix to its end less that of
    the prefix to its start, so that windows of the next length cost one pass and none is read word by word."""

    def __init__(self, words: np.ndarray):
        self.n = n = len(words)
        self.parts = []
        for p, base in _PRIMES:
            p64 = np.uint64(p)
            power = np.ones(n + 1, np.uint64)
            done, step = 1, base
            while done <= n:  # powers by doubling
                more = min(done, n + 1 - done)
                power[done : done + more] = power[:more] * np.uint64(step) % p64
                done, step = done * 2, step * step % p
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((words % p64 + np.uint64(1)) % p64 * power[:n] % p64, out=total[1:])
            self.parts.append((p64, power[::-1].copy(), total))

    def windows(self, length: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows of ``length`` words from the positions ``at``, comparable between texts by :meth:`align`."""
        out = []
        for p, lift, total in self.parts:
            out.append((total[at + length] - total[at]) % p * lift[at] % p)
        return (out[0] << np.uint64(31)) | out[1]


def _pieces(taken: np.ndarray, length: int) -> np.ndarray:
    """The first positions of windows of ``length`` words none of which is taken."""
    count = np.concatenate([[0], np.cumsum(taken)])
    return np.flatnonzero(count[length:] == count[: len(count) - length]) if length <= len(taken) else np.zeros(0, np.int64)


def tiles(item: np.ndarray, doc: np.ndarray, match: int) -> list[tuple[int, int, int]]:
    """Maximal non-overlapping matches ``(item position, document position, length)``, longest first; of ties the first in
    the item, then in the document.

    The search length runs: whether unmarked windows of a length occur on both sides falls with the length, so the longest is found by
    halving, each trial one pass of rolling hashes over either side. All tiles of that length are marked before the length
    falls again. Texts of n words have at most sqrt(2 n) different lengths of tiles, so the work is far from the
    product of the two lengths, for reordered and for repetitive texts.
    """
    item, doc = np.asarray(item).astype(np.uint64), np.asarray(doc).astype(np.uint64)
    n, m = len(item), len(doc)
    if n < match or m < match:
        return []
    # One hash over both texts, so that windows of either compare; no window lies across.
    both = RunningHash(np.concatenate([item, doc]))

    def common(length: int, free_i: np.ndarray, free_d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        i, d = _pieces(~free_i, length), _pieces(~free_d, length)
        h_i, h_d = both.windows(length, i), both.windows(length, d + n)
        keep = np.isin(h_d, h_i)
        return i, h_i, d[keep], h_d[keep]

    free_i, free_d = np.ones(n, bool), np.zeros(m, bool)
    # Only words of the document that lie in a run of ``match`` words of the item can be part of a tile.
    _, _, d, _ = common(match, free_i, np.ones(m, bool))
    if not len(d):
        return []
    free_d[(d[:, None] + np.arange(match)).ravel()] = True
    out: list[tuple[int, int, int]] = []
    most = min(n, int(_longest(free_d)))
    while most >= match:
        low, high = match, most
        best = common(low, free_i, free_d)
        if not len(best[2]):
            break
        # The length doubles while it finds something, then is bisected: short tiles after a long one are found in few trials.
        step = 1
        while low < high:
            trial = min(high, low + step) if step else (low + high + 1) // 2
            found = common(trial, free_i, free_d)
            if len(found[2]):
                low, best, step = trial, found, step * 2
            else:
                high, step = trial - 1, 0
        i, h_i, d, h_d = best
        order = np.argsort(h_d, kind="stable")
        d, h_d = d[order], h_d[order]
        first, last = np.searchsorted(h_d, h_i, side="left"), np.searchsorted(h_d, h_i, side="right")
        hit = np.flatnonzero(last > first)
        # Windows were free when this length began; what is marked since is as long, so two that overlap share an end of either.
        at: dict[int, int] = {}
        for x in hit.tolist():
            p, lo, hi = int(i[x]), int(first[x]), int(last[x])
            if not (free_i[p] and free_i[p + low - 1]):
                continue
            j = at.get(lo, lo)
            while j < hi:
                q = int(d[j])
                if free_d[q] and free_d[q + low - 1] and np.array_equal(item[p : p + low], doc[q : q + low]):
                    free_i[p : p + low] = free_d[q : q + low] = False
                    out.append((p, q, low))
                    j += 1
                    break
                j += 1
            at[lo] = j  # none before it will be free again
        most = low - 1
    return out


def _longest(free: np.ndarray) -> int:
    """The longest run of true values."""
    step = np.diff(np.concatenate([[0], free.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return int((ends - starts).max(initial=0))


def _seeds(bench: DataFrame, match: int, item: str, text: str) -> DataFrame:
    """``(item_id, words, seeds)`` of every benchmark item with at least ``match`` words."""
    kind = bench.schema[item].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in vec.slices(vec.as_strings(batch.column(1))):
                part = batch.slice(a, b - a)
                w = vec.words(part.column(1))
                h, first = vec.kgrams(w.hash, w.first, match)
                keep = pa.array(np.diff(first) > 0)
                cols = [part.column(0), vec.lists(w.hash.view(np.int64), w.first, pa.int64()), vec.lists(h.view(np.int64), first, pa.int64())]
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in cols], names=["item_id", "words", "seeds"])

    return bench.where(F.col(item).isNotNull()).select(item, text).mapInArrow(run, f"item_id {kind}, words array<long>, seeds array<long>")


def _shared_words(item: np.ndarray, hits: list[tuple[int, np.ndarray]], match: int) -> np.ndarray:
    """The words of a document that lie in seeds of the item, in order, with a word that the item doesn't have wherever others were
    left out: ``hits`` has an item position of each seed and the document positions that hold it."""
    at = np.concatenate([x for _, x in hits]).astype(np.int64)
    of = np.repeat([i for i, _ in hits], [len(x) for _, x in hits])
    order = np.argsort(at)
    at, of = at[order], of[order]
    place, first = np.unique((at[:, None] + np.arange(match)).ravel(), return_index=True)
    words = item[(of[:, None] + np.arange(match)).ravel()[first]]
    gap = np.flatnonzero(np.diff(place) > 1) + 1
    none = np.uint64(0)
    while none in item:
        none += np.uint64(1)
    return np.insert(words, gap, none)


def find_leaks(
    docs: DataFrame, bench: DataFrame, threshold: float = 0.5, match: int = 5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``(doc_id, item_id, coverage, covered_words, item_words, n_tiles)`` of every pair of document and
    benchmark item of which tiles of ``match`` words or more cover at least ``threshold`` of the item's words.

    Documents are read once, as a whole, in vectorised passes; only the positions of seeds go on: what a document shares with
    an item can be spelled by the item. A pair is
    tiled only if the document holds the seeds of enough positions of the item: a tile of L words covers
    L - match + 1 of them, no less than L / match, so below ``threshold * words / match`` the threshold is out of
    reach. A seed counts at every position that has it: in an item that repeats a phrase, many share one.
    Benchmark seeds are sent to the tasks while they measure at most SENT_BYTES; beyond that all
    document seeds go through the join, which no longer depends on the benchmark fitting anywhere.

    Ids may be of any type that can be grouped by, text included. Null ids and null or empty texts on either side take part in nothing, nor do items of fewer than
    ``match`` words. A repeated row of either side changes nothing: a pair comes once, with its
    best-covered text. Of ties between tiles the first in the item wins. Very long texts are tiled
    whole. Empty tables give an empty result. Other columns of either side are never read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    doc_kind, item_kind = docs.schema[doc_id].dataType.simpleString(), bench.schema[item_id].dataType.simpleString()
    items = _seeds(bench, match, item_id, item_text).withColumn("item_version", F.xxhash64("words")).dropDuplicates(["item_id", "item_version"])
    items = scratch.keep(items, "items")
    places = items.select("item_id", "item_version", F.size("words").alias("item_words"), F.posexplode("seeds").alias("at", "seed"))
    seeds = places.groupBy("item_id", "item_version", "item_words", "seed").agg(F.count("*").alias("places"), F.min("at").alias("first"))
    n_seeds = seeds.count()
    if 8 * n_seeds <= SENT_BYTES:
        sent = np.unique(seeds.select("seed").distinct().toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))
        bits = np.zeros(1 << 22, bool)
        bits[(sent >> vec.U(42)).astype(np.int64)] = True
        shared = spark.sparkContext.broadcast((sent, np.packbits(bits)))
    else:
        shared = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, packed = shared.value if shared else (None, None)
        bits = np.unpackbits(packed).astype(bool) if shared else None
        for batch in batches:
            for a, b in vec.slices(vec.as_strings(batch.column(1))):
                part = batch.slice(a, b - a)
                w = vec.words(part.column(1))
                h, first = vec.kgrams(w.hash, w.first, match)
                if shared:
                    hit = bits[(h >> vec.U(42)).astype(np.int64)]
                    at = np.flatnonzero(hit)
                    at = at[np.searchsorted(known, h[at], side="right") > np.searchsorted(known, h[at], side="left")]
                else:
                    at = np.arange(len(h))
                if not len(at):
                    continue
                row = np.searchsorted(first, at, side="right") - 1
                # The same text under the same id again adds nothing; another text under it is a candidate of its own.
                rows = np.unique(row)
                version = np.zeros(len(first) - 1, np.int64)
                for r in rows.tolist():
                    version[r] = vec.digest(w.hash[w.first[r] : w.first[r + 1]])
                order = np.lexsort((at, h[at], row))
                at, row = at[order], row[order]
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[at[1:]] != h[at[:-1]])]))
                places = vec.lists((at - first[row]).astype(np.int32), np.append(new, len(at)), pa.int32())
                of = row[new]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(of)), pa.array(version[of]), pa.array(h[at[new]].view(np.int64)), places], names=["doc_id", "version", "seed", "held"]
                )

    hits = docs.where(F.col(doc_id).isNotNull()).select(doc_id, text).mapInArrow(run, f"doc_id {doc_kind}, version long, seed long, held array<int>")
    # One row a seed that a document shares: seeds that many items share are spread over documents, those that
    # many documents share over pairs, and repeated rows of a document are one element of the set.
    pairs = (
        hits.join(seeds, "seed")
        .groupBy("doc_id", "version", "item_id", "item_version", "item_words")
        .agg(F.collect_set(F.struct("first", "places", "held")).alias("seeds"))
        .where(F.aggregate("seeds", F.lit(0).cast("long"), lambda n, x: n + x["places"]) * match >= F.col("item_words") * threshold)
    )
    pairs = pairs.join(items.select("item_id", "item_version", F.col("words").alias("item")), ["item_id", "item_version"])
    pairs = pairs.select("doc_id", "item_id", "item", F.col("seeds.first").alias("first"), F.col("seeds.held").alias("held"))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for r, (item, first, held) in enumerate(zip(vec.rows(batch.column(2)), vec.rows(batch.column(3)), batch.column(4).to_pylist())):
                item = item.view(np.uint64)
                t = tiles(item, _shared_words(item, [(i, np.array(x)) for i, x in zip(first.tolist(), held)], match), match)
                covered = sum(k for _, _, k in t)
                if covered >= threshold * len(item):
                    at.append(r)
                    rows.append((covered / len(item), covered, len(item), len(t)))
            cols = list(zip(*rows)) or [[]] * 4
            kinds = [pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            chosen = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(chosen), batch.column(1).take(chosen), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names=["doc_id", "item_id", "coverage", "covered_words", "item_words", "n_tiles"]
            )

    tiled = pairs.mapInArrow(tile, f"doc_id {doc_kind}, item_id {item_kind}, coverage double, covered_words int, item_words int, n_tiles int")
    best = F.max(F.struct("coverage", "covered_words", "item_words", -F.col("n_tiles"))).alias("x")
    out = tiled.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.coverage", "x.covered_words", "x.item_words", (-F.col("x.col4")).alias("n_tiles"))
    out = scratch.keep(out, "leaks")
    scratch.drop("items")
    return out


def drop_leaks(docs: DataFrame, bench: DataFrame, **params) -> DataFrame:
    """``docs`` without the documents in which :func:`find_leaks` finds an item; all other rows and all columns stay.

    Rows that repeat an id are judged together; a row without an id goes by a fingerprint of its text; null and empty texts stay. Columns
    may have any names; empty tables give what is left of ``docs``."""
    doc_id, text = params.pop("doc_id", "doc_id"), params.pop("text", "text")
    key, leaked = unused(docs, "leak_key"), unused(docs, "leaked")
    keyed = docs.withColumn(key, own_key(docs, doc_id, text))
    leaks = find_leaks(keyed, bench, doc_id=key, text=text, **params).select(F.col("doc_id").alias(leaked)).distinct()
    return keyed.join(leaks, F.col(key) == F.col(leaked), "left_anti").drop(key)
