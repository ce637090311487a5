"""A corpus-cleaning pipeline: each stage is one training-data operator whose decisions take effect.

Every function takes (spark, docs, sf_dir), works on all of ``docs``, and returns a DataFrame; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfind.llm import bpe, decontaminate, near_dup, quality, queries, secrets
from lumenfind.llm.store import Scratch


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this input and its labels, rejects go.

    Null, empty and wordless texts go; a null id is no matter, as rows are judged where they are; repeated rows share their fate; long
    texts are read whole. Without any trusted positive, or any row, all stays. Columns may have any names.
    """
    return quality.keep_good(docs, queries.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies the document with the least id stays.

    Of rows that repeat an id one stays, that of the least text. A row without an id goes by a fingerprint of its text and gives way to copies
    with one. Null and empty texts are no copies. Long texts are taken whole; an empty table stays empty.
    """
    return near_dup.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Rows that repeat an id go together; a row without an id is judged by its text; null and empty texts stay. An item counts once however often the
    benchmark has it; with an empty benchmark, or one without any item long enough, all stays.
    """
    return decontaminate.drop_leaks(docs, queries.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; all documents stay, and n_chars counts the new text.

    Null, empty and clean texts stay as they are, with their n_chars; repeated rows, null ids and other columns are kept.
    """
    return secrets.redact_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, of repeated rows and rows without an id too.

    A null text gives nulls, an empty one an empty list; long texts are encoded whole; an empty table gives an empty result.
    """
    return bpe.encode_documents(docs, queries.VOCABULARY)


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secret redaction", redact_secrets),
    ("bpe encoding", encode),
]
#: Neither a fitted model nor tiling nor BPE can be written in SQL; tests hold the rows of run() against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next stage, and
    goes when that one's is written. The last stage reads what is left as its rows are asked for."""
    scratch = Scratch(spark, "pipeline")
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, f"stage-{k}")
            if k:
                scratch.drop(f"stage-{k - 1}")
    return docs
