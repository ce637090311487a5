"""Shared storage for intermediate tables, and connected components over edge tables.

Every intermediate table is written as Parquet under the folder that ``spark.checkpoint.dir``
names, which all executors share; lineage is cut there, so a lost executor costs only the tasks
that it was running. Only where that setting is absent (tests, a single machine) a temporary
folder takes its place.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared_dir


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column already (Spark doesn't tell case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_key(docs: DataFrame, row_id: str, text: str) -> Column:
    """The id of a row, or, of a row without one, a fingerprint of its text, so that every row can be judged. Fingerprints come
    after all ids in order (whole numbers from 2^62 on; of ids of any other kind text, with SHA-256): a row with an id goes before one without."""
    kind = docs.schema[row_id].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        print_ = F.shiftrightunsigned(F.xxhash64(F.lit(1), F.col(text)), 2) + F.lit(1 << 62)
        return F.coalesce(F.col(row_id).cast("long"), print_)
    return F.coalesce(F.col(row_id).cast("string"), F.concat(F.lit("\U0010ffff"), F.sha2(F.col(text), 256)))


#: Folders of all calls in this process, deleted when it ends: a result that is read lazily may need its tables till then.
_bases: dict[str, SparkSession] = {}


def clean() -> None:
    """Delete the tables of all calls so far. What their DataFrames have not yet been read for is lost; applications that run for
    long may call this between jobs. It runs at the end of the process in any case, as far as the session still lives."""
    while _bases:
        base, spark = _bases.popitem()
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(base)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session has ended
            continue


atexit.register(clean)


class Scratch:
    """Tables of one operator call, in a folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/lumenfind-{name}-{uuid.uuid4().hex}"
        _bases[self.base] = spark

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table as read back."""
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing needs any more; without names, all of them."""
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Label every node of an undirected edge table with the least node of its component.

    ``edges`` has columns ``a`` and ``b`` of one orderable type; loops and nulls are ignored, as
    are repeated edges. Returns ``(node, root)`` for each node with an edge. Alternating large-star
    and small-star steps (Kiveris et al. 2014): a logarithmic number of rounds even for long
    chains, every round one shuffle of the edges, and hubs of any degree cost no more than their
    edges. A round is written to the shared folder; nothing but two counts reaches the driver.
    """
    e = scratch.keep(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0"
    )
    n = 0
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        n += 1
        e = scratch.keep(small, f"{name}-{n}")
        scratch.drop(f"{name}-{n - 1}")
        # Done when it is a forest of stars: each node has one parent, and no parent has one itself.
        edges_now, nodes = e.agg(F.count("*"), F.count_distinct("a")).first()
        if edges_now == nodes and e.select(F.col("b").alias("a")).join(e.select("a"), "a", "left_semi").isEmpty():
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
