"""Token counts of documents in flat token files by a scan for separators.

A file is a run of little-endian token ids, each document closed by the end-of-document id, with no
index beside it. Blocks of files are read independently; in each, a vectorised search gives the separators' positions.
A document may begin blocks before it ends: a prefix scan over the blocks of a file carries the number of documents
and the last separator before each block, which stitches the boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .store import Scratch

#: Bytes of a file that one step of a task reads.
BLOCK = 8 << 20


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _publish(system: fs.FileSystem, unfinished: str, name: str) -> None:
    """Gives a complete file its name. Another attempt of the same task may have been first, and some file systems refuse to
    replace a file: then its bytes, which are the same, stay."""
    size = system.get_file_info(unfinished).size
    try:
        if system.get_file_info(name).type == fs.FileType.NotFound:
            system.move(unfinished, name)
            return
    except OSError:
        pass  # it appeared meanwhile, or the move failed for another reason, which shows below
    if system.get_file_info(name).size != size:  # none, or one that isn't ours
        raise OSError(f"can't write {name}")
    if system.get_file_info(unfinished).type != fs.FileType.NotFound:
        system.delete_file(unfinished)


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, end: int, doc_id: str = "doc_id", text: str = "text", width: int = 2) -> DataFrame:
    """Encode texts to one flat file per partition in ``folder`` (lazily: as the returned rows are computed).

    Returns ``(file, doc_index, doc_id)`` in file order. A file appears under its name when it is complete, and a task
    that runs again writes the same bytes, so lost executors and speculative copies do no harm. A null or empty text is a
    document without tokens.
    """
    kind = dict(docs.select(doc_id).dtypes)[doc_id]
    dtype = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}.bin"
        system, at = _open(folder)
        system.create_dir(at, recursive=True)
        unfinished = f"{at}/.{name}.{task.taskAttemptId()}"
        enc = bpe.load(vocabulary)
        mark = np.array([end], dtype).tobytes()
        n = 0
        with system.open_output_stream(unfinished) as out:
            for batch in batches:
                for t in batch.column(1):
                    t = t.as_py()
                    if t:
                        out.write(np.frombuffer(enc.encode(t), np.int32).astype(dtype).tobytes())
                    out.write(mark)
                yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows, pa.string()), pa.array(range(n, n + batch.num_rows), pa.int64()), batch.column(0)], names=["file", "doc_index", "doc_id"])
                n += batch.num_rows
        if not n:
            system.delete_file(unfinished)
        else:
            _publish(system, unfinished, f"{at}/{name}")

    return docs.select(doc_id, text).mapInArrow(run, f"file string, doc_index long, doc_id {kind}")


def count_tokens(spark: SparkSession, folder: str, end: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """``(file, doc_index, start, n_tokens, terminated)`` of each document in the files of ``folder``.

    ``start`` is the position of its first token in the file. Neighbouring separators enclose a document of 0
    tokens; tokens after a file's last separator are a document that isn't ``terminated``. A document of any length,
    over any number of blocks, is whole. Empty files and folders have no documents; a file whose size isn't a multiple of
    ``width`` raises ValueError.
    """
    dtype = np.dtype(f"<u{width}")
    block -= block % width
    system, at = _open(folder)
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if folder else []
    files = [(f.base_name, f.size) for f in found if f.type == fs.FileType.File and f.size and not f.base_name.startswith((".", "_"))]
    if bad := [n for n, size in files if size % width]:
        raise ValueError(f"not whole tokens: {bad[0]}")
    s = Scratch(spark, "token-counts")
    blocks = spark.createDataFrame(files, "file string, size long").select("file", "size", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long"))).alias("block", "start"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _open(folder)
        for batch in batches:
            for name, size, k, start in zip(*(c.to_pylist() for c in batch.columns)):
                with system.open_input_file(f"{at}/{name}") as f:
                    ids = np.frombuffer(f.read_at(min(block, size - start), start), dtype)
                marks = np.flatnonzero(ids == end) + start // width
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([k], pa.int32()), pa.array([size // width], pa.int64()), pa.array([len(marks)], pa.int64()), pa.array([marks[-1] if len(marks) else -1], pa.int64()), pa.array([marks], pa.list_(pa.int64()))],
                    names=["file", "block", "tokens", "n", "last", "marks"],
                )

    scanned = s.keep(blocks.repartition("file", "block").mapInArrow(scan, "file string, block int, tokens long, n long, last long, marks array<long>"), "blocks")
    # The prefix scan works on a few numbers a block; the positions stay where they are.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = scanned.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("docs"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"))
    closed = scanned.where("n > 0").select("file", "block", "marks").join(carried, ["file", "block"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The separators of all blocks of a batch at once; the first of each block closes what earlier blocks began.
            n = batch.column(1).value_lengths().to_numpy()
            m = batch.column(1).flatten().to_numpy()
            first = np.cumsum(n) - n
            start = np.empty(len(m), np.int64)
            start[1:] = m[:-1] + 1
            start[first] = batch.column(3).to_numpy() + 1
            row = np.repeat(np.arange(len(n)), n)
            index = np.arange(len(m)) - first[row] + batch.column(2).to_numpy()[row]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(index), pa.array(start), pa.array(m - start), pa.array(np.ones(len(m), bool))], names=["file", "doc_index", "start", "n_tokens", "terminated"]
            )

    whole = closed.select("file", "marks", "docs", "carry").mapInArrow(stitch, "file string, doc_index long, start long, n_tokens long, terminated boolean")
    tail = scanned.groupBy("file").agg(F.max("tokens").alias("tokens"), F.sum("n").alias("doc_index"), F.max("last").alias("last")).where("last + 1 < tokens")
    return whole.union(tail.select("file", "doc_index", (F.col("last") + 1).alias("start"), (F.col("tokens") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("terminated")))


def count_document_tokens(docs: DataFrame, vocabulary: str, end: int, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``(doc_id, n_tokens, file, doc_index)``: texts written as flat token files in the shared folder, the files scanned for
    separators, and each document found in them named by its place in the order of writing.

    Null and empty texts count 0 tokens; null and repeated ids are kept as they are, one result per row. An empty
    table gives an empty result; other columns are never read. The token files go when they are counted; :func:`write_token_files` keeps them.
    """
    spark = docs.sparkSession
    s = Scratch(spark, "tokens")
    folder = f"{s.base}/files"
    order = s.keep(write_token_files(docs, vocabulary, folder, end, doc_id, text), "order")
    counts = count_tokens(spark, folder, end, block=block)
    out = s.keep(counts.join(order, ["file", "doc_index"]).select("doc_id", "n_tokens", "file", "doc_index"), "counts")
    s.drop("files", "order")
    return out
