"""What keeps the engine's work in proportion to its input: what is shuffled, what is held, and that results stay whole."""

import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenfind import queries
from lumenfind.operators import index as I
from lumenfind.operators import ranking
from lumenfind.operators.index import DocumentIndex
from lumenfind.schema import DocumentSchema, FieldDef

DATA = Path("/root/testdata/sf0.001")


def exchanges(df):
    """What is shuffled by, of the plan before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("Exchange ")[1].split(",")[0] for line in plan.splitlines() if "Exchange hash" in line or "Exchange range" in line or "Exchange Round" in line]


def random_texts(spark, seed, docs=60, words=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return spark.createDataFrame([(d, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 8)))) for d in range(docs)], "doc_id long, text string")


def small_index(spark, texts, path=None):
    index = DocumentIndex.create(spark, DocumentSchema.of(FieldDef("text"), FieldDef("number", "u64", no_pipe=True)), path)
    index.set_pipeline("text WhitespaceTokenizer > NumberFilter | [number] > LowercaseFilter")
    index.set_query_pipeline("WhitespaceTokenizer > NumberFilter | [Any in number] > LowercaseFilter > [All in text]")
    index.add_documents(texts, {"text": "text"})
    return index.commit()


def test_f1_the_first_results_are_among_the_leading_operands(spark):
    """a batch with a limit joins few postings, and gives what it gives without one."""
    index = small_index(spark, random_texts(spark, 1)).persist()
    asked = random_texts(spark, 2, docs=12).select(F.col("doc_id").alias("query_id"), "text")
    every = [(r.query_id, r.rank, r.doc_id, r.step) for r in index.run_queries(asked).collect()]
    ops = ranking.batch_operands(index, asked).persist()
    for limit in (1, 3, 7, 100):
        got = [(r.query_id, r.rank, r.doc_id, r.step) for r in index.run_queries(asked, limit).collect()]
        assert sorted(got) == sorted(r for r in every if r[1] <= limit)
        kept = {}
        for r in ranking._leading(ops, limit).collect():
            kept.setdefault(r.query_id, []).append((r.bit, r.df))
        assert all(df < limit for of in kept.values() for _, df in sorted(of, reverse=True)[:-1])
    assert ranking._leading(ops, 1).count() == ops.select("query_id").distinct().count() < ops.count()


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_f2_postings_meet_where_their_texts_are(spark, tmp_path, monkeypatch, few):
    """a commit shuffles texts by document, and of old postings those of documents that come again; the rest stays."""
    monkeypatch.setattr(I, "FEW", few)
    first = [(1, "a b 7 A"), (2, "b c"), (1, "c 7"), (None, "z"), (5, None)]
    index = small_index(spark, spark.createDataFrame(first, "doc_id long, text string"), str(tmp_path / "index"))
    index.add_documents(spark.createDataFrame([(2, "C d 8"), (3, "a a"), (2, "b 8"), (1, "a b")], "doc_id long, text string"), {"text": "text"})
    assert all(x.startswith("hashpartitioning(doc_id") for x in exchanges(I.distinct(index._buffer)))
    index.commit()
    want = {1: "a b c 7", 2: "b c d 8", 3: "a"}
    for i in (index, DocumentIndex.load(spark, str(tmp_path / "index"))):
        assert sorted((r.key, r.doc_id) for r in i.postings().select(I.term_key().alias("key"), "doc_id").collect()) == sorted((t, d) for d, x in want.items() for t in x.split())
        assert i.n_docs() == {"text": 3, "number": 2}
    assert [s.rows for s in index._segments] == [6, 3]


IN_MEMORY = "idf_weights term_df term_enumeration postings rank_duplicate_term rank_multi rank_topk rank_long rank_batch filter_two filter_must filter_only_query explain_operands and_all_terms weight_guard external_ids rank_fields_group frequent_terms".split()


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_f3_to_f7_f10_large_indexes_are_not_held(spark, monkeypatch):
    """above KEPT_BYTES nothing but a query's own postings is held, with the same results."""
    monkeypatch.setattr(queries, "KEPT_BYTES", 0)
    monkeypatch.setattr(queries, "_kept", {})
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    text = lambda v: repr(round(v, 6)) if isinstance(v, float) else repr(v)
    for name in IN_MEMORY:
        rel = con.sql(queries.ORACLE_SQL[name])
        got = [tuple(text(r[c]) for c in rel.columns) for r in queries.QUERIES[name](spark, str(DATA)).collect()]
        assert sorted(got) == sorted(tuple(map(text, r)) for r in rel.fetchall()), name
    assert queries._kept and all(i._counted is None and not i._full.is_cached for i in queries._kept.values())
    index = queries.text_index(spark, str(DATA))
    assert "text" not in " ".join(exchanges(index._full)) and all("doc_id" in x and "term" not in x for x in exchanges(index._full))
    # A lookup's condition reaches the texts: what is made distinct are the postings of its terms.
    index.unpersist()
    plan = index.hits([("text", "the")])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.index("Exchange") < plan.index("= the)")


def test_f8_f9_counts_shuffle_texts_and_vocabularies(spark, tmp_path):
    """F8, F9: tokens are counted within documents where these are; ids that repeat and null ones count as in SQL."""
    rows = [(1, "a b a"), (1, "a c"), (2, "b"), (None, "a"), (None, "a d"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("tok_whitespace", "tok_again"):
        df = queries.QUERIES[name](spark, str(tmp_path))
        assert [x.split("#")[0] for x in exchanges(df)] == ["hashpartitioning(token", "hashpartitioning(doc_id"]
        assert sorted(map(tuple, df.collect())) == [("a", 5, 1), ("b", 2, 2), ("c", 1, 1), ("d", 1, 0)]
