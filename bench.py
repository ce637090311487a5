"""Times the headline queries and prints one line of JSON.

BENCH_SF_DIR names the tables (default: /root/testdata/sf0.1), BENCH_CPUS the cores (default: 4). The index is built once, with files under
a temporary folder; each query then runs once to warm up and three times for the median. Results are collected.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ["PYTHONPATH"] = f"{sys.path[0]}:{os.environ.get('PYTHONPATH', '')}"

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "4"))
TERMS = {"rank_1_term": "in", "rank_3_terms": "in the of", "rank_6_terms": "in the of das erver licensed"}


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from lumenfind.operators.index import DocumentIndex
    from lumenfind.operators.query import Query
    from lumenfind.queries import NUMBERED, NUMBERED_QUERY, QUERIES
    from lumenfind.schema import DocumentSchema, FieldDef

    folder = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", str(2 * CPUS))
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{folder}/shared")
        .config("spark.local.dir", f"{folder}/local")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name: str, run, times: int = 3) -> None:
        run()
        each = []
        for _ in range(times):
            began = time.perf_counter()
            run()
            each.append(time.perf_counter() - began)
        took[name] = round(statistics.median(each), 3)

    def build(path: str) -> DocumentIndex:
        index = DocumentIndex.create(spark, DocumentSchema.of(FieldDef("text"), FieldDef("number", "u64", no_pipe=True, filter=True)), path)
        index.set_pipeline(NUMBERED)
        index.add_documents(spark.read.parquet(f"{SF_DIR}/documents.parquet"), {"text": "text"})
        index.commit()
        return index

    n = iter(range(100))
    timed("index_build", lambda: build(f"file://{folder}/index-{next(n)}"), 1)
    index = DocumentIndex.load(spark, f"file://{folder}/index-1")
    index.set_query_pipeline(NUMBERED_QUERY)
    batch = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text").orderBy("query_id").limit(100)
    for name, text in TERMS.items():
        timed(f"{name}_from_files", lambda t=text: index.run_query(t, limit=10).collect(), 2)
    timed("batch_100_queries_from_files", lambda: index.run_queries(batch, limit=10).collect(), 2)
    index.persist()
    for name, text in TERMS.items():
        timed(name, lambda t=text: index.run_query(t, limit=10).collect())
    timed("rank_filtered", lambda: index.run_query(Query("the of in").filter_by("number", 555), limit=10).collect())
    timed("batch_100_queries", lambda: index.run_queries(batch, limit=10).collect(), 2)
    timed("facets_top_100", lambda: index.frequent_terms("number").limit(100).collect())
    timed("stem_vocabulary", lambda: QUERIES["stem_vocab"](spark, SF_DIR).write.format("noop").mode("overwrite").save(), 1)
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1], "cpus": CPUS}))


if __name__ == "__main__":
    main()
