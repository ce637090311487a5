"""Folders that all executors share, and small files in them."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only where that is unset, on a single machine, a temporary one."""
    global _own
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="lumenfind-")
        atexit.register(shutil.rmtree, _own, True)
    return f"file://{_own}"


def _open(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    p, system = _open(spark, folder)
    return [x.getPath().getName() for x in system.listStatus(p)] if system.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    p, system = _open(spark, path)
    stream = system.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file that readers see whole or not at all; FileExistsError if there is one."""
    unfinished, system = _open(spark, f"{path}.unfinished")
    target, _ = _open(spark, path)
    if system.exists(target):
        raise FileExistsError(path)
    stream = system.create(unfinished, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not system.rename(unfinished, target):
        raise FileExistsError(path)


def delete(spark: SparkSession, path: str) -> None:
    p, system = _open(spark, path)
    system.delete(p, True)
