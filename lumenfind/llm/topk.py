"""Exact top-k search by pivot distances (iDistance, Jagadish et al. 2005) for a set of queries against all vectors.

Vectors are keyed by their nearest pivot and the distance to it, and packed in that order into blocks of bounded size. The
search of a query's own block gives it a first k-th distance. By the triangle inequality a vector x of pivot p
can be that near to q only if |d(q, p) - d(x, p)| isn't larger: a query is sent to the blocks of which some annulus may hold such a vector,
and there the sorted annuli around d(q, p) are expanded outwards until the bound exceeds the k-th distance so far.

Where vectors cluster, most blocks are never visited; where distances concentrate (independent dimensions), no exact bound
excludes much, and the search becomes a blocked scan of all vectors for all queries at the speed of matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

#: Vectors in a block: what a task holds of either side.
BLOCK = 8192
#: Points that a block of queries is compared with at once, and queries in such a block.
SLAB, QUERIES = 2048, 256


def _squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by a matrix product, and how far each may be off by rounding, which grows with the norms."""
    n_x, n_y = (x * x).sum(1)[:, None], (y * y).sum(1)[None]
    d = n_x + n_y - 2 * (x @ y.T)
    return np.maximum(d, 0, out=d), 8 * x.shape[1] * np.finfo(float).eps * (n_x + n_y)


def _bounds(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances, and how far each may be off."""
    d, off = _squares(x, y)
    return np.sqrt(d), np.sqrt(d + off) - np.sqrt(np.maximum(d - off, 0))


class _Best:
    """The k nearest of each query so far, and ``radius``, the k-th distance (at first the one that is known)."""

    def __init__(self, q: np.ndarray, own: np.ndarray, k: int, radius: np.ndarray):
        self.q, self.own, self.k, self.radius = q, own, k, radius
        none = (np.zeros(0), np.zeros(0, np.int64))
        self.found = [none] * len(q)

    def offer(self, at: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        """Compare queries ``at`` with the points x. Distances that may decide are computed again, term by term, so
        that equal vectors tie exactly."""
        d, off = _squares(self.q[at], x)
        rows, cols = np.nonzero((d <= np.square(self.radius[at])[:, None] + off) & (self.own[at][:, None] != ids[None]))
        first = np.searchsorted(rows, np.arange(len(at) + 1))
        for r in np.flatnonzero(np.diff(first)):
            i, c = at[r], cols[first[r] : first[r + 1]]
            if len(c) > 4 * self.k:
                near = d[r, c]
                c = c[near - off[r, c] <= np.partition(near + off[r, c], self.k - 1)[self.k - 1]]
            exact = np.sqrt(((x[c] - self.q[i]) ** 2).sum(1))
            d_all, i_all = np.concatenate([self.found[i][0], exact]), np.concatenate([self.found[i][1], ids[c]])
            order = np.lexsort((i_all, d_all))[: self.k]
            self.found[i] = d_all[order], i_all[order]
            if len(order) == self.k:
                self.radius[i] = min(self.radius[i], d_all[order[-1]])

    def table(self) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "vec_id": np.repeat(self.own, [len(d) for d, _ in self.found]),
                "neighbour_id": np.concatenate([i for _, i in self.found]),
                "distance": np.concatenate([d for d, _ in self.found]),
            }
        )


def search_block(points: pd.DataFrame, queries: pd.DataFrame, pivots: np.ndarray, k: int) -> pd.DataFrame:
    """Nearest ``points`` (vec_id, v, pivot, dist) of each of ``queries`` (vec_id, v, radius): by pivot, annuli outwards."""
    if not len(queries) or not len(points):
        return pd.DataFrame({"vec_id": queries["vec_id"][:0], "neighbour_id": points["vec_id"][:0], "distance": np.zeros(0)})
    # Ids of any type, by their order.
    codes, names = pd.factorize(pd.concat([points["vec_id"], queries["vec_id"]], ignore_index=True), sort=True)
    q = np.frombuffer(b"".join(queries["v"]), np.float64).reshape(len(queries), -1)
    x = np.frombuffer(b"".join(points["v"]), np.float64).reshape(len(points), -1)
    best = _Best(q, codes[len(points) :].astype(np.int64), k, queries["radius"].to_numpy(float).copy())
    order = np.lexsort((points["dist"].to_numpy(), points["pivot"].to_numpy()))
    x, ids = x[order], codes[: len(points)].astype(np.int64)[order]
    pivot, dist = points["pivot"].to_numpy()[order], points["dist"].to_numpy()[order]
    parts = [(p, *np.searchsorted(pivot, [p, p + 1])) for p in np.unique(pivot)]
    to, off = _bounds(q, pivots[[p for p, _, _ in parts]])
    # Runs of neighbouring annuli; several small pivots share a run, with the bound of each.
    runs = []
    for n, (_, a, b) in enumerate(parts):
        runs += [(n, i, min(i + SLAB, b)) for i in range(a, b, SLAB)]
    of, low, high = np.array([n for n, _, _ in runs]), dist[[a for _, a, _ in runs]], dist[[b - 1 for _, _, b in runs]]
    for at in range(0, len(q), QUERIES):
        rows = np.arange(at, min(at + QUERIES, len(q)))
        d = to[rows][:, of]
        bound = (np.maximum(low - d, d - high) - off[rows][:, of]).T
        near = bound.min(1)
        pending: list[int] = []
        size = 0
        for r in [*np.argsort(near, kind="stable"), -1]:
            # Nearest annuli first; small ones are compared together.
            if r >= 0:
                if not (bound[r] <= best.radius[rows]).any():
                    continue
                pending.append(r)
                size += runs[r][2] - runs[r][1]
            if pending and (r < 0 or size >= SLAB):
                take = np.concatenate([np.arange(runs[p][1], runs[p][2]) for p in pending])
                some = (bound[pending] <= best.radius[rows]).any(0)
                best.offer(rows[some], x[take], ids[take])
                pending, size = [], 0
    out = best.table()
    return out.assign(vec_id=names.take(out["vec_id"]), neighbour_id=names.take(out["neighbour_id"]))


def nearest_neighbours(
    vectors: DataFrame, k: int = 10, n_pivots: int | None = None, block: int = BLOCK, vec_id: str = "vec_id", embedding: str = "embedding", queries: Column | None = None
) -> DataFrame:
    """``(vec_id, rank, neighbour_id, distance)``: the k nearest other vectors, among all, of every vector that the condition ``queries`` (on
    ``vec_id``; by default all) names, by Euclidean distance, ties by id.

    ``n_pivots`` defaults to the square root of the number of vectors, 2048 at most; pivots are the vectors whose ids hash
    lowest, and are sent to all tasks (2048 pivots of 1000 dimensions are 16 MB). All vectors are in the index. A task holds at most ``block`` vectors of
    either side; a pivot with more is cut into blocks of neighbouring annuli, and the queries that come to a block into lots.

    Ids may be of any type that has an order, text included. Null ids and vectors that are null, empty, or hold nulls, NaN or infinities take part in nothing, and neither do those of a length
    other than the commonest (of ties the largest). An id that repeats counts once, with its least vector. With k or fewer
    other vectors all are neighbours; a single vector, or an empty table, has none. Equal vectors are at distance 0 and
    rank by id. Other columns are never read.
    """
    spark = vectors.sparkSession
    s = Scratch(spark, "topk")
    kind = vectors.schema[vec_id].dataType.simpleString()
    asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    finite = ~F.exists(embedding, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    clean = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & (F.size(embedding) > 0) & finite)
    clean = clean.groupBy(F.col(vec_id).alias("vec_id"), asked.alias("asked")).agg(F.min(F.col(embedding).cast("array<double>")).alias("v"))
    clean = s.keep(clean, "vectors")
    result = f"vec_id {kind}, rank int, neighbour_id {kind}, distance double"
    common = clean.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None or common["count"] < 2:
        return spark.createDataFrame([], result)
    dims, total = common["d"], common["count"]
    clean = clean.where(F.size("v") == dims)
    n_pivots = n_pivots or int(min(2048, max(1, total**0.5)))
    chosen = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).collect()
    shared = spark.sparkContext.broadcast(np.array([r.v for r in chosen], float))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(-1, dims)
            at = _squares(x, shared.value)[0].argmin(1)
            exact = np.sqrt(((x - shared.value[at]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(at.astype(np.int32)), pa.array(exact)], names=["vec_id", "asked", "v", "pivot", "dist"])

    keyed = s.keep(clean.select("vec_id", "asked", "v").mapInArrow(key, f"vec_id {kind}, asked boolean, v binary, pivot int, dist double"), "keyed")
    # Blocks in the order of (pivot, distance): whole pivots while they fit, else runs of annuli.
    counts = {r.pivot: r["count"] for r in keyed.groupBy("pivot").count().collect()}
    first, at, room = {}, 0, block
    for p in sorted(counts):
        if counts[p] > room and room < block:
            at, room = at + 1, block
        first[p] = at
        if counts[p] > block:
            at, room = at + -(-counts[p] // block), block
        else:
            room -= counts[p]
    starts = spark.createDataFrame([(p, b) for p, b in first.items()], "pivot int, first_block int")
    nth = F.row_number().over(Window.partitionBy("pivot").orderBy("dist", "vec_id")) - 1
    blocks = keyed.withColumn("n", nth).join(F.broadcast(starts), "pivot").select("vec_id", "asked", "v", "pivot", "dist", (F.col("first_block") + F.floor(F.col("n") / block)).cast("int").alias("block"))
    blocks = s.keep(blocks, "blocks")
    s.drop("vectors", "keyed")
    summary = blocks.groupBy("block", "pivot").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    ranges = [(r.block, r.pivot, r.lo, r.hi) for r in summary.collect()]
    shared_ranges = spark.sparkContext.broadcast(pd.DataFrame(ranges, columns=["block", "pivot", "lo", "hi"]).sort_values(["block", "pivot"]))
    found = f"vec_id {kind}, neighbour_id {kind}, distance double"

    def within(points: pd.DataFrame) -> pd.DataFrame:
        return search_block(points, points[points["asked"]].assign(radius=np.inf), shared.value, k)

    inner = s.keep(blocks.groupBy("block").applyInPandas(within, found), "within")
    radius = inner.groupBy("vec_id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("radius"))
    asking = blocks.where("asked").select("vec_id", "v", "block").join(radius, "vec_id", "left")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared_ranges.value
        cut = np.flatnonzero(np.diff(r["block"].to_numpy(), prepend=-1))
        names = r["block"].to_numpy()[cut]
        lo, hi, piv = r["lo"].to_numpy(), r["hi"].to_numpy(), r["pivot"].to_numpy()
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                q = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, dims)
                to, off = _bounds(q, shared.value)
                to, off = to[:, piv], off[:, piv]
                bound = np.minimum.reduceat(np.maximum(lo - to, to - hi) - off, cut, axis=1)
                most = batch.column(3).fill_null(np.inf).to_numpy()
                rows, cols = np.nonzero((bound <= most[:, None]) & (names[None] != batch.column(2).to_numpy()[:, None]))
                sent = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(names[cols], pa.int32()), sent.column(0), sent.column(1), pa.array(most[rows])], names=["block", "vec_id", "v", "radius"])

    sent = asking.select("vec_id", "v", "block", "radius").mapInArrow(send, f"block int, vec_id {kind}, v binary, radius double")
    # A task's work is a block and a lot of the queries that come to it; lots hold half a block on average, so that none is much larger than one.
    n_asking = inner.select("vec_id").distinct().count()
    lots = max(1, -(-2 * n_asking // block))
    sent = sent.withColumn("lot", F.pmod(F.xxhash64("vec_id"), F.lit(lots)))
    meet = s.keep(sent.select("block", "lot").distinct(), "meet")
    points = blocks.join(meet, "block").select("block", "lot", "vec_id", "v", "pivot", "dist")

    def between(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return search_block(points, queries, shared.value, k)

    outer = points.groupBy("block", "lot").cogroup(sent.groupBy("block", "lot")).applyInPandas(between, found)
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbour_id"))
    out = inner.union(outer).withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    out = s.keep(out.select("vec_id", "rank", "neighbour_id", F.round("distance", 5).alias("distance")), "result")
    s.drop("blocks", "within", "meet")
    return out
