"""WARC, BPE, token counts, top-k, sharding and the pipeline: against brute force, round trips, and the cases that each must define."""

import base64
import json
import os
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from lumenfind.llm import bpe, queries, sharding, token_counts, topk, warc
from lumenfind.llm.store import Scratch

import corpus_pipeline

needs_vocabulary = pytest.mark.skipif(not os.path.exists(queries.VOCABULARY), reason="no vocabulary here")
DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no tables here")
SAMPLES = [
    "", " ", "  two  spaces ", "don't they'll\n\n\nx\t\ty \r\n", "naïve Ünïcödé — “quotes” 日本語 テキスト 한국어 🙂🙃", "a" * 3000, "ab" * 5000, " " * 500,
    "x1y2z3 3.14159 1,000,000", "\0null\0", " nbsp em　ideographic", "end of line \n start", "<|endoftext|>", "the the the the", "́combining é", "...!?!?---",
]
RECORD = "record_id string, record_type string, concurrent_to array<string>, target_uri string, payload string"


def fuzz(r):
    return "".join(r.choice("ab cdeT\n 'sé1.,\t") if r.random() < 0.98 else r.choice("日🙂 \0") for _ in range(r.randint(0, 400)))


@needs_vocabulary
def test_bpe_equals_the_public_encoder():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.VOCABULARY, "rb"))}
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    enc = bpe.load(queries.VOCABULARY)
    r = random.Random(1)
    for text in [*SAMPLES, *(fuzz(r) for _ in range(300))]:
        ids = memoryview(enc.encode(text)).cast("i").tolist()
        assert ids == other.encode_ordinary(text), text[:80]
        assert enc.decode(ids).decode() == text


@needs_vocabulary
def test_bpe_table(spark):
    texts = [*SAMPLES, None, "hello world " * 50_000, "hello", "hello"]
    docs = spark.createDataFrame([(i, t, "z", None) for i, t in enumerate(texts)], "doc_id long, text string, token_ids string, n_tokens string")
    got = sorted(bpe.encode_documents(docs, queries.VOCABULARY).collect())
    enc = bpe.load(queries.VOCABULARY)
    assert len(got) == len(texts)
    for x, t in zip(got, texts):
        if t is None:
            assert x.token_ids is None and x.n_tokens is None and x.decoded_ok is None
        else:
            assert x.decoded_ok and len(x.token_ids) == x.n_tokens and enc.decode(x.token_ids).decode() == t
    assert bpe.encode_documents(docs.limit(0), queries.VOCABULARY).collect() == []


@needs_vocabulary
@pytest.mark.parametrize("block", [2, 64, 8 << 20])
def test_token_counts(spark, block):
    r = random.Random(2)
    rows = [(i, fuzz(r)) for i in range(40)] + [(None, "x"), (3, "again"), (100, None), (101, ""), (102, "long " * 4000)]
    docs = spark.createDataFrame([(*x, "z", None) for x in rows], "doc_id long, text string, file string, n_tokens string").repartition(3)
    if block == 2:  # one token a block, on a smaller table
        rows, docs = rows[:6], docs.where("doc_id < 6 and text <> 'again'")
    got = token_counts.count_document_tokens(docs, queries.VOCABULARY, queries.END_OF_DOCUMENT, block=block).collect()
    enc = bpe.load(queries.VOCABULARY)
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((x.doc_id, x.n_tokens) for x in got), key=key) == sorted(((i, len(enc.encode(t or "")) // 4) for i, t in rows), key=key)
    assert token_counts.count_document_tokens(docs.limit(0), queries.VOCABULARY, queries.END_OF_DOCUMENT).collect() == []


@pytest.mark.parametrize("width", [2, 4])
def test_separator_scan(spark, tmp_path, width):
    r, want = random.Random(3), []
    for f in range(4):
        ids = [r.choice([9, 9, 1, 2, 3]) if f % 2 else r.choice([9, *[5] * 30]) for _ in range(r.randint(1, 200))]
        np.array(ids, f"<u{width}").tofile(tmp_path / f"{f}.bin")
        start = 0
        for n, (a, b) in enumerate(zip([-1, *[i for i, x in enumerate(ids) if x == 9]], [*[i for i, x in enumerate(ids) if x == 9], None])):
            start = a + 1
            if b is not None:
                want.append((f"{f}.bin", n, start, b - start, True))
            elif start < len(ids):
                want.append((f"{f}.bin", n, start, len(ids) - start, False))
    (tmp_path / "empty.bin").touch()
    for block in (width, 7 * width + 1, 1 << 20):
        assert sorted(map(tuple, token_counts.count_tokens(spark, str(tmp_path), 9, width, block).collect())) == sorted(want)
    (tmp_path / "bad.bin").write_bytes(b"x")
    with pytest.raises(ValueError):
        token_counts.count_tokens(spark, str(tmp_path), 9, width)
    assert token_counts.count_tokens(spark, str(tmp_path / "nowhere"), 9, width).collect() == []


def nearest_by_force(rows, k):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in zip(ids, x):
        d = np.sqrt(((x - v) ** 2).sum(1))
        out[i] = [(j, round(float(e), 5)) for e, j in sorted(zip(d, ids)) if j != i][:k]
    return out


@pytest.mark.parametrize("block, pivots", [(8192, None), (16, 5), (16, 1), (7, 40)])
def test_top_k(spark, block, pivots):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(90, 6)) + 20 * (np.arange(90) % 3)[:, None], np.tile(r.normal(size=6), (25, 1))]).astype("float32")
    rows = [(1000 - i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for g in topk.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 5, pivots, block).orderBy("vec_id", "rank").collect():
        got.setdefault(g.vec_id, []).append((g.neighbour_id, g.distance))
    want = nearest_by_force(rows, 5)
    assert {i: [j for j, _ in v] for i, v in got.items()} == {i: [j for j, _ in v] for i, v in want.items()}
    assert all(abs(a - b) < 2e-5 for i in got for (_, a), (_, b) in zip(got[i], want[i]))


def test_top_k_cases(spark):
    nan = float("nan")
    rows = [(1, [0.0, 0.0]), (2, [0.0, 3.0]), (2, [9.0, 9.0]), (3, [4.0, 0.0]), (3, [4.0, 0.0]), (4, None), (5, []), (None, [0.0, 0.0]), (6, [1.0]), (7, [nan, 1.0]), (8, [None, 1.0]), (9, [float("inf"), 1.0])]
    schema = "vec_id long, embedding array<double>, rank string, v string, block string, dist string"
    vectors = spark.createDataFrame([(*x, "z", None, "z", None) for x in rows], schema)
    got = [tuple(x) for x in topk.nearest_neighbours(vectors, 10).orderBy("vec_id", "rank").collect()]
    assert got == [(1, 1, 2, 3.0), (1, 2, 3, 4.0), (2, 1, 1, 3.0), (2, 2, 3, 5.0), (3, 1, 1, 4.0), (3, 2, 2, 5.0)]
    assert topk.nearest_neighbours(vectors.limit(0), 3).collect() == []
    assert topk.nearest_neighbours(vectors.where("vec_id = 1"), 3).collect() == []


def test_sharding(spark):
    rows = [(i, f"k{i}") for i in range(20_000)] + [(None, None), (None, ""), (5, "k5"), (-1, "x" * 1_000_000)]
    df = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, name string, jump_key string")
    got = sharding.assign_shards(df, ["doc_id", "name"], 50, 10).collect()
    assert len(got) == len(rows) and all(x.jump_key == "z" for x in got)
    assert all((x.shard == x.shard_after) if not x.moved else x.shard_after >= 50 for x in got)
    moved = sum(x.moved for x in got) / len(got)
    assert abs(moved - 10 / 60) < 0.015
    sizes = np.bincount([x.shard for x in got], minlength=50)
    assert sizes.min() > 300 and sizes.max() < 500
    same = {(x.doc_id, x.name): x.shard for x in got}
    assert all(same[x.doc_id, x.name] == x.shard for x in got)
    null, empty = (next(x for x in sharding.assign_shards(df, ["name"], 1 << 30).collect() if x.name == n).shard for n in (None, ""))
    assert null != empty
    assert sharding.assign_shards(df.limit(0), ["doc_id"], 5).collect() == []
    with pytest.raises(ValueError):
        sharding.jump_buckets(np.zeros(1, np.uint64), 0)
    # the published loop, one key at a time
    for key in (0, 1, 256, 0xDEADBEEF10408, 2**64 - 1):
        k, b, j = key, -1, 0
        while j < 1000:
            b = j
            k = (k * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * ((1 << 31) / ((k >> 33) + 1)))
        assert sharding.jump_buckets(np.array([key], np.uint64), 1000)[0] == b


def captures_by_force(rows):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    named = [x for x in rows if x[0] is not None]
    for i, _, links, *_ in named:
        find(i)
        for b in links or []:
            if b:
                x, y = find(i), find(b)
                root[max(x, y)] = min(x, y)
    out = {}
    for i in {x[0] for x in named}:
        out.setdefault(find(i), set()).add(i)
    return sorted(sorted(x) for x in out.values())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_warc_against_force(spark, seed):
    r = random.Random(seed)
    names = [f"u{i:02}" for i in range(60)]
    rows = [(n, r.choice(["response", "request", "metadata", None, "warcinfo"]), r.choice([None, [], [r.choice(names)], [r.choice(names), "gone"][: r.randint(1, 2)]]), "http://x", n) for n in names[:50]]
    got = warc.assemble(spark.createDataFrame(rows, RECORD)).collect()
    members = sorted(sorted([*([x.response.record_id] if x.response else []), *(y.record_id for c in ("requests", "metadata", "others") for y in x[c])]) for x in got)
    assert members == captures_by_force(rows)
    assert all(x.n_records == len(m) for x, m in zip(sorted(got, key=lambda x: min([x.response.record_id if x.response else "~", *(y.record_id for c in ("requests", "metadata", "others") for y in x[c])])), members))


def test_warc_cases(spark):
    long = "x" * 2_000_000
    rows = [
        ("a", "response", None, "http://a", long), ("b", "request", ["a"], "http://a", None), ("c", "metadata", ["b", "", None, "c"], None, ""),
        ("c", "metadata", ["b"], None, ""), ("d", "response", ["a"], "http://d", "late"), ("e", None, None, None, None), (None, "response", ["a"], "x", "y"),
        ("f", "request", ["nobody"], "http://f", "1"), ("g", "request", ["nobody"], "http://g", "2"),
    ]
    records = spark.createDataFrame([(*x, "z", None) for x in rows], RECORD + ", capture_id string, root string")
    got = {x.capture_id: x for x in warc.assemble(records).collect()}
    assert sorted(got) == ["a", "e", "f"]
    a = got["a"]
    assert a.response.payload == long and [x.record_id for x in a.requests] == ["b"] and [x.record_id for x in a.metadata] == ["c"] and [x.record_id for x in a.others] == ["d"]
    assert (a.target_uri, a.n_records) == ("http://a", 4)
    assert got["e"].response is None and got["e"].n_records == 1 and [x.record_id for x in got["f"].requests] == ["f", "g"]
    assert warc.assemble(records.limit(0)).collect() == []
    pages = spark.createDataFrame([(1, "u", "h"), (2, None, None), (None, "u", "h"), (1, "u", "h")], "page_id long, url string, html string")
    assert sorted(x.n_records for x in warc.assemble(warc.pages_to_records(pages)).collect()) == [3, 3]


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    rel = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, str(DATA))
    text = lambda v: repr(round(v, 4)) if isinstance(v, float) else repr(v)
    assert sorted(got.columns) == sorted(rel.columns)
    assert sorted(tuple(text(x[c]) for c in rel.columns) for x in got.collect()) == sorted(tuple(map(text, x)) for x in rel.fetchall())


@needs_data
@needs_vocabulary
def test_pipeline_is_its_stages(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    docs, seen, scratch = documents, [documents.count()], Scratch(spark, "test-pipeline")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.keep(stage(spark, docs, str(DATA)), str(k))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == documents.columns
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] > seen[3] == seen[4] == seen[5]
    got = corpus_pipeline.run(spark, str(DATA)).collect()
    assert sorted(got) == sorted(docs.collect())
    enc = bpe.load(queries.VOCABULARY)
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{scratch.base}/3").collect()}
    assert all(enc.decode(x.token_ids).decode() == texts[x.doc_id] for x in got)
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    first = {x.doc_id for x in spark.read.parquet(f"{scratch.base}/0").collect()}
    judged = [(labels[i] == 1) == (i in first) for i in labels]
    assert sum(judged) >= 0.97 * len(judged)


@needs_vocabulary
def test_pipeline_on_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for n, rows in enumerate([[], [(1, None, None, None, None), (None, "some text of no id", "en", "s", 4), (2, "", "en", "s", 0), (3, "same words", "en", "s", 10), (4, "same words", "en", "s", 10), (4, "same words", "en", "s", 10)]]):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        got = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert sorted(str(x.doc_id) for x in got) == ([], ["1", "2", "3", "None"])[n]
    assert all(json.dumps(x.token_ids) for x in got)
