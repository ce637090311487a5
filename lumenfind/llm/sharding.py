"""Jump consistent hashing (Lamping and Veach, 2014): keys to shards without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import unused


def jump_buckets(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each 64-bit key; about ln(n_shards) vectorised steps, no memory that grows with it."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    key = keys.astype(np.uint64, copy=True)
    shard = np.zeros(len(key), np.int64)
    at, jump = np.arange(len(key)), np.zeros(len(key), np.int64)
    with np.errstate(over="ignore"):
        while len(at):
            shard[at] = jump
            key = key * np.uint64(2862933555777941757) + np.uint64(1)
            jump = ((jump + 1) * (2147483648.0 / ((key >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
            go = jump < n_shards
            at, key, jump = at[go], key[go], jump[go]
    return shard


def stable_key(*columns: Column | str) -> Column:
    """A 64-bit key from the MD5 of the columns' text: the same in every engine, session and release.

    Each column contributes its length and its text, so that neighbouring columns can't run into each
    other; a null is told from an empty text.
    """
    parts = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    digest = F.substring(F.md5(F.concat(*parts)), 1, 16)
    # conv() yields an unsigned decimal; as a signed long it has the same 64 bits.
    high, low = (F.conv(F.substring(digest, i, 8), 16, 10).cast("long") for i in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def shard_of(key: Column, n_shards: int) -> Column:
    """The shard, 0 to n_shards - 1, of a 64-bit key; null for a null key."""

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_buckets(keys.to_numpy(np.int64).view(np.uint64), n_shards).astype(np.int32))

    return F.when(key.isNotNull(), jump(F.coalesce(key, F.lit(0).cast("long"))))


def assign_shards(df: DataFrame, key_columns: list[str], n_shards: int, appended: int = 0, prefix: str = "shard") -> DataFrame:
    """Adds ``shard``, and with ``appended`` also ``shard_after`` (with that many more shards) and ``moved``.

    The key is hashed JVM-side; only eight bytes a row reach Python. No shuffle. Growing from n to
    n + a shards moves the fraction a / (n + a) of the keys, each to one of the new shards.

    Rows with equal keys share a shard, repeated rows too; null and empty keys are keys like any
    other (and differ from each other); a very long key costs one pass of MD5. An empty table gives
    an empty one. Other columns stay; columns named as an output are replaced.
    """
    key = unused(df, "jump_key")
    out = df.withColumn(key, stable_key(*key_columns)).withColumn(prefix, shard_of(F.col(key), n_shards))
    if appended:
        out = out.withColumn(f"{prefix}_after", shard_of(F.col(key), n_shards + appended))
        out = out.withColumn("moved", F.col(prefix) != F.col(f"{prefix}_after"))
    return out.drop(key)
