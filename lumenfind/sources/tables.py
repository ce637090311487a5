"""Reading tables of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_documents(spark: SparkSession, path: str, columns: dict[str, str], doc_id: str, format: str = "parquet", **options) -> DataFrame:
    """A table in any format Spark reads, as ``doc_id`` and the named columns (new name to source column)."""
    df = spark.read.format(format).options(**options).load(path)
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), *(F.col(c).alias(n) for n, c in columns.items()))
