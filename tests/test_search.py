"""The index and ranking: a small corpus, edge cases, and a literal enumeration as the oracle."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumenfind.functions.stemming import porter2
from lumenfind.operators.hierarchy import Hierarchy
from lumenfind.operators.index import FANOUT, DocumentIndex, bucket_number
from lumenfind.operators.progress import progress
from lumenfind.operators.query import ChainingOperator, Query
from lumenfind.operators.ranking import all_of, cut_off
from lumenfind.plans.pipeline import Bucket, Collected, Pipeline, run_into
from lumenfind.schema import DocumentSchema, FieldDef, FieldGroup, Supplement

TEXT = "text WhitespaceTokenizer > NumberFilter | [number] > LowercaseFilter > Stemmer(English)"
TITLE = "title WhitespaceTokenizer > LowercaseFilter > Stemmer(English)"
ASK = "WhitespaceTokenizer > NumberFilter | [Any in number] > LowercaseFilter > Stemmer(English) > [{} in {}]"


def literal(weights, docs, filtered):
    """Ranking by trying all numbers of missing operands in order; docs: id -> set of operand positions by rising weight."""
    n, out = len(weights), []
    for c in range(2**n):
        active = [i for i in range(n) if not c >> i & 1]
        if c and (not active or sum(weights[i] for i in active) < 0.01 * sum(weights)):
            break
        if not active and filtered is None:
            break
        for d in sorted(docs):
            if d not in out and all(i in docs[d] for i in active) and (filtered is None or d in filtered):
                out.append(d)
    return out


def fixture(spark, path=None):
    schema = DocumentSchema.of(FieldDef("text"), FieldDef("title"), FieldDef("number", "u64", no_pipe=True, filter=True), FieldDef("mails", "usize", no_pipe=True))
    index = DocumentIndex.create(spark, schema, path)
    index.set_pipeline(TEXT)
    index.set_pipeline(TITLE)
    docs = [(0, None, "10 geese passed above BEN Nevis"), (1, None, "125 geese passed behind The harbour"), (2, "Griffins near Ceres", "2567 griffins passed from pallas towards ceres")]
    df = spark.createDataFrame(docs, "doc_id long, title string, text string")
    index.add_documents(df, {"text": "text", "title": "title"})
    index.commit()
    index.set_query_pipeline(ASK.format("All", "text"))
    return index


@pytest.fixture(scope="module")
def index(spark):
    return fixture(spark)


def ids(index, query, **k):
    return [r.doc_id for r in index.run_query(query, **k).collect()]


def test_small_corpus(index):
    index.set_query_pipeline(ASK.format("All", "text"))
    assert ids(index, "10 ceres") == [2, 0]
    assert ids(index, "2567 ceres") == [2]
    assert ids(index, "2567 ceres pallas") == [2]
    assert ids(index, "harbour") == [1]
    assert ids(index, "passed") == [0, 1, 2]
    assert ids(index, Query("passed").filter_by("number", 2567)) == [2]
    index.set_query_pipeline(ASK.format("Any", "title"))
    assert ids(index, "10") == [0]
    assert ids(index, "10 pizza") == [0]
    assert ids(index, "ceres") == [2]


def test_edge_cases(index):
    index.set_query_pipeline(ASK.format("All", "text"))
    assert ids(index, "") == [] and ids(index, "pizza") == []
    assert ids(index, Query("pizza").filter_by("text", "gees")) == [0, 1]
    assert ids(index, Query("").filter_by("text", "gees").filter_by("number", 10)) == [0]
    assert ids(index, Query("ceres").filter_by("text", "gees")) == []
    assert ids(index, Query("passed").filter_by("text", "pizza")) == [0, 1, 2]
    assert ids(index, Query("passed", strict_filters=True).filter_by("text", "pizza")) == []
    assert [o.term for o in __import__("lumenfind.operators.query", fromlist=["x"]).query_operands(index, Query("passed passed ceres"))] == ["pass", "pass", "cere"]
    assert [(r.rank, r.doc_id) for r in index.run_query("passed ceres", 2).collect()] == [(1, 2), (2, 0)]
    with pytest.raises(NotImplementedError):
        Query("x").filter_by("text", "y", ChainingOperator.MUST_NOT)
    with pytest.raises(RuntimeError):
        DocumentIndex.create(index.spark, DocumentSchema.of(FieldDef("text"))).run_query("x")
    row = index.explain_query("ceres").first()
    assert row.description.startswith('Querying term "cere" on field "text" with weight Weight(')


def test_cut_off():
    rng = random.Random(1)
    for _ in range(3000):
        w = sorted(rng.choice([rng.random(), rng.random() / 300, 1.0]) for _ in range(rng.randint(1, 8)))
        c = next((c for c in range(1, 2 ** len(w)) if sum(w[i] for i in range(len(w)) if not c >> i & 1) < 0.01 * sum(w)), 2 ** len(w))
        assert cut_off(w) == c
    assert cut_off([0.001, 1.0]) == 2


@pytest.mark.parametrize("seed", range(4))
def test_ranking_against_enumeration(spark, seed):
    rng = random.Random(seed)
    schema = DocumentSchema.of(FieldDef("light", term_doc_ratio=700.0), FieldDef("heavy"))
    index = DocumentIndex.create(spark, schema)
    held = {f: {d: {w for w in "abcdef" if rng.random() < 0.4} for d in range(40)} for f in ("light", "heavy")}
    for f in held:
        index.put(f, spark.createDataFrame([(d, w) for d, ws in held[f].items() for w in sorted(ws)] * 2, "doc_id long, term string"))
    index.commit()
    index.set_query_pipeline(lambda q: _both(spark, q, rng))
    weights = {(r.field, r.term): r.weight for r in index.dictionary().collect()}
    for _ in range(2):
        words = [rng.choice("abcdefz") for _ in range(rng.randint(1, 3))]
        ops = [(weights[f, w], n, f, w) for n, w in enumerate(words) for f in ("heavy", "light") if (f, w) in weights]
        ops.sort(key=lambda o: (o[0], o[1], o[2]))
        docs = {d: s for d in range(40) if (s := {i for i, (_, _, f, w) in enumerate(ops) if w in held[f][d]})}
        expected = literal([o[0] for o in ops], docs, None)
        assert ids(index, " ".join(words)) == expected
        batch = index.run_queries(spark.createDataFrame([(7, " ".join(words))], "query_id long, text string"))
        assert [r.doc_id for r in batch.orderBy("rank").collect()] == expected


def _both(spark, queries, rng):
    from pyspark.sql import functions as F

    words = queries.select("query_id", F.posexplode(F.split("token", " ")).alias("n", "term"))
    row = lambda t: words.select("query_id", F.lit(t).alias("target"), F.lit(0).alias("branch"), F.array("n").alias("pos"), "term", F.lit(None).cast("decimal(20,0)").alias("term_num"))
    return row("light").union(row("heavy"))


def test_many_operands(spark, index):
    index.set_query_pipeline(ASK.format("All", "text"))
    query = " ".join(["passed geese ceres harbour"] * 20)
    # The terms that one document has weigh the same, of these the last word's last place the most.
    assert ids(index, query) == [1, 2, 0]
    one = [(r.doc_id, r.step) for r in index.run_query(query).collect()]
    many = index.run_queries(spark.createDataFrame([(0, query)], "query_id long, text string")).orderBy("rank").collect()
    assert one == [(r.doc_id, r.step) for r in many] and len(one[0][1]) == 80
    for n in (61, 62, 63, 124, 125):
        query = " ".join((["passed geese ceres harbour"] * 32)[: n // 4 + 1]).split()[:n]
        ops = index.explain_query(" ".join(query)).orderBy("bit").collect()
        held = {0: {"pass", "gees"}, 1: {"pass", "gees", "harbour"}, 2: {"pass", "cere"}}
        steps = {d: "".join("0" if o.term in held[d] else "1" for o in reversed(ops)) for d in held}
        assert {r.doc_id: r.step for r in index.run_query(" ".join(query)).collect()} == steps


def test_and(spark, index):
    p = index
    assert [r.doc_id for r in all_of(p, [("text", "gees"), ("text", "pass")]).orderBy("doc_id").collect()] == [0, 1]
    assert [r.doc_id for r in all_of(p, [("text", "pass")], start=1, limit=1).collect()] == [1]
    assert all_of(p, []).count() == 0 and all_of(p, [("text", "zz"), ("text", "pass")]).count() == 0


def test_facets_commits_and_storage(spark, tmp_path):
    path = str(tmp_path / "index")
    index = fixture(spark, path)
    more = spark.createDataFrame([(3, "125 10"), (4, "10"), (5, "10"), (0, "10 geese")], "doc_id long, text string")
    index.add_documents(more, {"text": "text"})
    before = index.postings().count()
    assert [(r.df, r.term) for r in index.frequent_terms("number").collect()] == [(1, "10"), (1, "125"), (1, "2567")]
    index.commit()
    again = DocumentIndex.load(spark, path)
    for i in (index, again):
        assert [(r.df, r.term) for r in i.frequent_terms("number").collect()] == [(4, "10"), (2, "125"), (1, "2567")]
        assert i.postings().count() == before + 4
    again.set_query_pipeline(ASK.format("All", "text"))
    assert ids(again, "10 ceres") == ids(index, "10 ceres") == [2, 0, 3, 4, 5]
    assert again.measured_ratio("number") == 7 / 6 and again.n_docs() == {"number": 6, "text": 3, "title": 1}
    with pytest.raises(ValueError):
        index.frequent_terms("text")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_open_their_buckets(spark, tmp_path):
    index = DocumentIndex.create(spark, DocumentSchema.of(FieldDef("text"), FieldDef("number", "u64")), str(tmp_path / "index"), buckets=16)
    index.set_pipeline("text WhitespaceTokenizer > NumberFilter | [number] > LowercaseFilter")
    index.set_query_pipeline("WhitespaceTokenizer > NumberFilter | [number] > LowercaseFilter > [All in text]".replace("[number]", "[All in number]"))
    index.add_documents(spark.createDataFrame([(i, f"word{i} {i} both") for i in range(300)], "doc_id long, text string"), {"text": "text"})
    index.commit()
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)  # plans are shown whole
    terms = [("text", "word7"), ("text", "both"), ("number", "007")]
    want = {"word7": bucket_number("word7", 16), "both": bucket_number("both", 16), "7": bucket_number("7", 16)}
    for df in (index.hits(terms), index.dictionary(terms=terms)):
        filters = plan(df).split("PartitionFilters: [")[1].split("PushedFilters")[0]
        assert "bucket" in filters and all(str(b) in filters for b in want.values())
        assert "PushedFilters: [" in plan(df) and "In(term" in plan(df)
    assert sorted(map(tuple, index.hits(terms[:1] + terms[2:]).collect())) == [("number", "7", 7), ("text", "word7", 7)]
    # The number of documents is in the manifest: the one scan is of the dictionary.
    assert index.n_docs() == {"text": 300, "number": 300} and plan(index.dictionary(terms=terms)).count("FileScan") == 1
    assert ids(index, "word7 7") == [7]


def test_a_commit_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    index = fixture(spark, path)
    before = sorted(map(tuple, index.postings().collect()))
    index.add_documents(spark.createDataFrame([(9, "10 more geese")], "doc_id long, text string"), {"text": "text"})
    monkeypatch.setattr("lumenfind.sources.folders.publish_text", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        index.commit()
    for i in (index, DocumentIndex.load(spark, path)):
        assert sorted(map(tuple, i.postings().collect())) == before
    monkeypatch.undo()
    index.commit()
    assert DocumentIndex.load(spark, path).postings().count() == len(before) + 3 == index.postings().count()
    # A second writer finds the manifest's number taken.
    other = DocumentIndex.load(spark, path)
    index.save_schema()
    other.add_documents(spark.createDataFrame([(10, "x")], "doc_id long, text string"), {"text": "text"})
    with pytest.raises(FileExistsError):
        other.commit()
    with pytest.raises(FileNotFoundError):
        DocumentIndex.load(spark, str(tmp_path / "nowhere"))


def test_segments_merge(spark, tmp_path):
    path = str(tmp_path / "index")
    index = DocumentIndex.create(spark, DocumentSchema.of(FieldDef("text", filter=True)), path)
    rows = [(i % 7, f"w{i % 5}") for i in range(40)]
    for a in range(0, 40, 4):
        index.put("text", spark.createDataFrame(rows[a : a + 4], "doc_id long, term string"))
        index.commit()
    assert len(index._segments) < FANOUT and sum(s.rows for s in index._segments) == len(set(rows))
    df = {t: len({d for d, x in rows if x == t}) for _, t in rows}
    for i in (index, DocumentIndex.load(spark, path), DocumentIndex.load(spark, path).merge()):
        assert {r.term: r.df for r in i.dictionary().collect()} == df and i.n_docs() == {"text": 7}
        assert sorted((r.doc_id, r.term) for r in i.postings().collect()) == sorted(set(rows))
    last = DocumentIndex.load(spark, path)
    assert len(last._segments) == 1
    last.save_schema()
    last.save_schema()
    assert sorted(p.name for p in (tmp_path / "index").iterdir() if p.is_dir()) == [last._segments[0].name]
    assert len([p for p in (tmp_path / "index").iterdir() if p.name.startswith("manifest") and p.suffix == ".json"]) == 2


def test_what_a_load_brings_back(spark, tmp_path):
    path = str(tmp_path / "index")
    index = fixture(spark, path)
    index.external_ids = spark.createDataFrame([(i, ("k", i)) for i in range(3)], "doc_id long, e struct<a:string,b:int>")
    index.external_ids = spark.createDataFrame([(i, ("m", i)) for i in range(3)], "doc_id long, e struct<a:string,b:int>")
    again = DocumentIndex.load(spark, path)
    assert [tuple(r.ext_id) for r in again.run_query("10 ceres").collect()] == [("m", 2), ("m", 0)]
    assert [(r.rank, tuple(r.ext_id)) for r in again.run_query("10 ceres", 1).collect()] == [(1, ("m", 2))]
    again.add_documents(spark.createDataFrame([(2, "Sphinxes")], "doc_id long, title string"), {"title": "title"})
    again.commit()
    assert DocumentIndex.load(spark, path).dictionary("title").where("term = 'sphinx'").count() == 1


def test_functions_sinks_and_term_types(spark):
    from datetime import date

    schema = DocumentSchema.of(FieldDef("text"), FieldDef("day", "date", filter=True), FieldDef("price", "decimal(10,2)", filter=True), FieldDef("size", "usize"))
    index = DocumentIndex.create(spark, schema)
    with pytest.raises(ValueError):
        index.set_pipeline(lambda texts: texts)
    with pytest.raises(ValueError):
        FieldDef("x", "map")

    def pairs(texts):
        halves = texts.select("doc_id", F.split("token", "/").alias("p"))
        return halves.select(F.lit("text").alias("field"), "doc_id", F.col("p")[0].alias("term")).union(halves.select(F.lit("day"), "doc_id", F.col("p")[1]))

    index.set_pipeline(pairs, "text")
    docs = spark.createDataFrame([(1, "x/2024-03-01"), (2, "y/2023-12-31"), (3, "x/2023-12-31"), (4, None)], "doc_id long, text string")
    index.add_documents(docs, {"text": "text"})
    index.put("price", spark.createDataFrame([(1, "9.5"), (2, "10.5"), (3, None)], "doc_id long, term string"))
    index.put("size", spark.createDataFrame([(1, 7)], "doc_id long, term int"))
    index.commit()
    assert [(r.df, r.term) for r in index.frequent_terms("day").collect()] == [(2, "2023-12-31"), (1, "2024-03-01")]
    assert [r.term for r in index.frequent_terms("price").collect()] == ["9.50", "10.50"]
    index.set_query_pipeline("LowercaseFilter > [All in text]")
    assert ids(index, Query("x").filter_by("day", date(2023, 12, 31))) == [3]
    assert ids(index, Query("").filter_by("size", 7)) == [1]
    sink = Collected()
    run_into(Pipeline.parse("text WhitespaceTokenizer > LowercaseFilter"), docs.withColumnRenamed("text", "token"), lambda name: sink)
    assert sorted((r.doc_id, r.term) for r in sink.streams[0].collect()) == [(1, "x/2024-03-01"), (2, "y/2023-12-31"), (3, "x/2023-12-31")]
    with pytest.raises(NotImplementedError):
        Bucket().put(docs)


def test_weights_that_are_not_positive(spark):
    for idf in (lambda n, df: F.log(n / df), lambda n, df: F.when(df > 1, F.lit(float("nan"))).otherwise(1.0)):
        index = DocumentIndex.create(spark, DocumentSchema.of(FieldDef("text")), idf=idf)
        index.put("text", spark.createDataFrame([(1, "all"), (2, "all"), (1, "one")], "doc_id long, term string"))
        index.commit()
        index.set_query_pipeline("WhitespaceTokenizer > LowercaseFilter > [All in text]")
        assert [r.term for r in index.explain_query("all one").collect()] == ["one"] and ids(index, "all one") == [1] and ids(index, "all") == []
        assert [r.doc_id for r in index.run_queries(spark.createDataFrame([(1, "all one"), (2, "all")], "query_id long, text string")).collect()] == [1]


def test_stemmed_ranking_against_plain_python(spark):
    words = "connect connected connecting connection relate related relating ski skis skies sky generous generally happy happily die dying lie lying".split()
    rng = random.Random(3)
    docs = [(d, " ".join(rng.choices(words, k=4))) for d in range(60)]
    index = DocumentIndex.create(spark, DocumentSchema.of(FieldDef("text")))
    index.set_pipeline("text WhitespaceTokenizer > LowercaseFilter > Stemmer(English)")
    index.set_query_pipeline("WhitespaceTokenizer > LowercaseFilter > Stemmer(English) > [All in text]")
    index.add_documents(spark.createDataFrame(docs, "doc_id long, text string"), {"text": "text"})
    index.commit().persist()
    held = {d: {porter2(w) for w in t.split()} for d, t in docs}
    for query in ("connections skies", "Relatedness happily dying lies"):
        terms = [t for w in query.lower().split() if any((t := porter2(w)) in h for h in held.values())]
        weight = [math.log(1 + len(docs) / sum(t in h for h in held.values())) for t in terms]
        order = sorted(range(len(terms)), key=lambda i: (weight[i], i))
        sets = {d: s for d, h in held.items() if (s := {n for n, i in enumerate(order) if terms[i] in h})}
        assert ids(index, query) == literal([weight[i] for i in order], sets, None) and len(sets) > 5


def test_progress(spark):
    import threading
    import time

    assert progress(spark) == 1.0 and progress(spark, "nobody") == 1.0
    slow = F.udf(lambda x: time.sleep(0.2) or x, "long")
    seen = []
    job = threading.Thread(target=lambda: spark.range(0, 24, 1, 12).select(slow("id")).collect())
    job.start()
    while job.is_alive():
        seen.append(progress(spark))
        time.sleep(0.05)
    job.join()
    assert min(seen) < 1 and all(0 <= x <= 1 for x in seen) and progress(spark) == 1.0


def test_groups_and_external_ids(spark):
    index = DocumentIndex.create(spark, DocumentSchema.of(FieldGroup("body")))
    index.add_field("body", "a")
    index.add_field("body", "b", Supplement.FILTER)
    with pytest.raises(ValueError):
        index.add_field("body", "a")
    for f in "ab":
        index.set_pipeline(f"{f} WhitespaceTokenizer > LowercaseFilter")
    docs = spark.createDataFrame([(1, "x y", "z"), (2, "z", "x"), (3, None, "")], "doc_id long, a string, b string")
    index.add_documents(docs, {"a": "a", "b": "b"})
    index.commit()
    index.set_query_pipeline("WhitespaceTokenizer > LowercaseFilter > [Any in body]")
    assert len(index.explain_query("x").collect()) == 2
    assert ids(index, "x") == [2, 1]  # equal weights: the field later by name has the higher bit
    index.external_ids = spark.createDataFrame([(1, ("k", 1)), (2, ("k", 2))], "doc_id long, e struct<a:string,b:int>")
    assert [tuple(r.ext_id) for r in index.run_query("x").collect()] == [("k", 2), ("k", 1)]
    index.external_ids = spark.createDataFrame([(1, "one")], "doc_id long, e string")
    with pytest.raises(Exception, match="unknown document id 2"):
        index.run_query("x").collect()


def test_hierarchy(spark):
    h = Hierarchy.of(spark, [("A", None), ("B", None), ("A1", "A"), ("A2", "A")])
    names = lambda df: [r.term for r in df.collect()]
    assert names(h.get_root_terms()) == ["A", "B"] and names(h.get_child_terms("A")) == ["A1", "A2"]
    assert names(h.get_child_terms("B")) == [] and h.get_child_terms("C") is None
    for bad in (("A", None), ("C1", "C")):
        with pytest.raises(ValueError):
            h.add_element(*bad)
    assert names(Hierarchy.from_table(h.edges).get_child_terms("A")) == ["A1", "A2"]
    for rows in ([(0, "A", None), (1, "A", None)], [(0, "A", "B"), (1, "B", None)], [(0, "A", "Z")]):
        with pytest.raises(ValueError):
            Hierarchy.from_table(spark.createDataFrame(rows, "ord long, term string, parent string"))


def test_empty_hierarchy_and_facets(spark):
    h = Hierarchy(spark)
    assert h.get_root_terms().collect() == [] and h.get_child_terms("A") is None
    index = DocumentIndex.create(spark, DocumentSchema.of(FieldDef("text", filter=True), FieldGroup("none")))
    assert index.frequent_terms("text").collect() == [] and index.n_docs() == {}
    index.set_query_pipeline("WhitespaceTokenizer > LowercaseFilter > [All in none]")
    assert ids(index, "x") == [] and index.run_queries(spark.createDataFrame([(1, "x")], "query_id long, text string")).collect() == []


def test_empty_index(spark):
    index = DocumentIndex.create(spark, DocumentSchema.of(FieldDef("text")))
    index.set_pipeline("text WhitespaceTokenizer > LowercaseFilter")
    index.set_query_pipeline("WhitespaceTokenizer > LowercaseFilter > [All in text]")
    assert ids(index, "x") == []
    index.add_documents(spark.createDataFrame([(1, None)], "doc_id long, text string"), {"text": "text"})
    index.commit()
    assert ids(index, "x") == [] and index.dictionary().count() == 0


def test_stream(spark, tmp_path):
    from lumenfind.streaming import index_stream

    index = DocumentIndex.create(spark, DocumentSchema.of(FieldDef("text")), str(tmp_path / "index"))
    index.set_pipeline("text WhitespaceTokenizer > LowercaseFilter")
    index.set_query_pipeline("WhitespaceTokenizer > LowercaseFilter > [All in text]")
    for n in range(2):
        spark.createDataFrame([(n, f"word{n} both")], "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    index_stream(index, stream, {"text": "text"}, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination(120)
    assert ids(index, "both") == [0, 1] and ids(index, "word1") == [1]
