"""Whole queries, and the pipeline, against versions that try everything; ids that are text; what tasks that run twice do."""

import base64
import math
import os
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from lumenfind.llm import bpe, decontaminate, license_scan, near_dup, quality, queries, secrets, sharding, token_counts, topk
from test_text_operators import groups_by_force, prose, split, table, tiles_by_force

import corpus_pipeline

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no tables here")
needs_vocabulary = pytest.mark.skipif(not os.path.exists(queries.VOCABULARY), reason="no vocabulary here")


def secrets_by_force(text):
    """Every window of every candidate, each entropy from scratch; ``(from, to, class)`` of a text whose runs hold no words of placeholders."""

    def mixed(s):
        return any(c.isdigit() for c in s) and any(c.isalpha() for c in s)

    def entropy(s):
        return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())

    out = []
    for run in re.finditer(r"[A-Za-z0-9+/_-]+", text or ""):
        assert not (re.search(secrets.WORDS, run[0]) and mixed(run[0]))
        if any(re.fullmatch(a, run[0]) for a in secrets.ALLOW):
            continue
        marks = []
        for n, cls in enumerate(secrets.CLASSES):
            for part in re.finditer(f"[{re.escape(cls.characters)}]+", run[0]):
                p, w = part[0], cls.window
                if not mixed(p) or any(re.fullmatch(a, p) for a in secrets.ALLOW):
                    continue
                hot = [i for i in range(len(p) - w + 1) if entropy(p[i : i + w]) >= cls.bits - 1e-9]
                covered = sorted({x for i in hot for x in range(i, i + w)})
                if covered and covered[0] < w:
                    covered = [*range(covered[0]), *covered]
                if covered and len(p) - 1 - covered[-1] < w:
                    covered = [*covered, *range(covered[-1] + 1, len(p))]
                pieces = []
                for x in covered:
                    if pieces and x == pieces[-1][1]:
                        pieces[-1][1] = x + 1
                    else:
                        pieces.append([x, x + 1])
                marks += [(a + part.start(), b + part.start(), n) for a, b in pieces if mixed(p[a:b])]
        while True:  # join any two that overlap, till none do
            pair = next(((x, y) for x in marks for y in marks if x is not y and x[0] < y[1] and y[0] < x[1]), None)
            if pair is None:
                break
            x, y = pair
            marks = [m for m in marks if m is not x and m is not y] + [(min(x[0], y[0]), max(x[1], y[1]), min(x[2], y[2]))]
        out += [(a + run.start(), b + run.start(), secrets.CLASSES[n].name) for a, b, n in marks]
    return sorted(out)


def secret_texts():
    r = random.Random(21)
    letters = {c.name: c.characters for c in secrets.CLASSES}
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 8)):
            chars = r.choice([*letters.values(), "ab1", "é日x", "0123456789"])
            parts.append("".join(r.choices(chars, k=r.choice([5, 15, 16, 17, 19, 20, 21, 40, 90]))) + r.choice(["", " ", "=", "é", "/", "0" * 30, "a" * 25]))
        texts.append("".join(parts))
    return [t for t in texts if not re.search(secrets.WORDS, t)]


def test_secrets_against_force(spark):
    texts = secret_texts()
    got = {}
    for x in secrets.find_secrets(table(spark, list(enumerate(texts)))).collect():
        got.setdefault(x.doc_id, []).append((x.start, x.start + x.length, x["class"]))
        assert texts[x.doc_id][x.start : x.start + x.length] == x.secret
    assert {i: sorted(v) for i, v in got.items()} == {i: f for i, t in enumerate(texts) if (f := secrets_by_force(t))}


@needs_data
def test_secret_query_against_force(spark):
    rows = [x for x in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect() if not re.search(secrets.WORDS, x.text or "")]
    ids = {x.doc_id for x in rows}
    got = Counter((x.doc_id, x.start, x.start + x.length, x["class"]) for x in queries.op9_secrets(spark, str(DATA)).collect() if x.doc_id in ids)
    assert got == Counter((x.doc_id, *f) for x in rows for f in secrets_by_force(x.text)) and len(rows) > 150


def test_many_secrets_in_one_run_are_linear():
    import time

    classes, took = (secrets.CharClass("hex", "0123456789abcdef", 16, 2.5),), []
    r = random.Random(2)
    for n in (1000, 8000):
        run = "".join("".join(r.choices("0123456789abcdef", k=20)) + "0" * 20 for _ in range(n))
        began = time.perf_counter()
        assert len(secrets.scan_text(run, classes, [])) > n / 2
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * took[0]


def licenses_by_force(rows, known, k=3, gap=3, similarity=0.8):
    found = set()
    for d, text in rows:
        words = split(text)
        for name, template in known.items():
            t = split(template)
            hits = sorted((p - q, q) for p in range(len(words) - k + 1) for q in range(len(t) - k + 1) if words[p : p + k] == t[q : q + k])
            spans = []
            for diagonal, q in hits:
                if spans and diagonal - spans[-1][1] <= gap:
                    spans[-1][1] = diagonal
                    spans[-1][2].add(q)
                else:
                    spans.append([diagonal, diagonal, {q}])
            for lo, hi, votes in spans:
                start = max(0, lo)
                part = words[start : start + max(1, hi - start + len(t))]
                row = [0] * (len(part) + 1)
                for x in t:
                    last, row = row, [0]
                    for j, y in enumerate(part):
                        row.append(max(last[j] + 1 if x == y else 0, row[j], last[j + 1]))
                if row[-1] >= similarity * len(t) - 1e-9:
                    at = [i for i, x in enumerate(part) if x in t]
                    found.add((d, name, start + at[0], at[-1] - at[0] + 1, len(votes), round(row[-1] / len(t), 6), row[-1]))

    def beaten(x):
        return any(y[0] == x[0] and x[2] < y[2] + y[3] and y[2] < x[2] + x[3] and (y[6], y[5]) > (x[6], x[5]) for y in found)

    return {x[:6] for x in found if not beaten(x)}


@pytest.mark.parametrize("sent", [0, 64 << 20])
def test_licenses_against_force(spark, monkeypatch, sent):
    monkeypatch.setattr(license_scan, "SENT_BYTES", sent)
    r = random.Random(23)
    known = {n: t for n, t in license_scan.TEMPLATES.items() if n in ("MIT", "Apache-2.0-line", "GPL", "BSD", "CC-BY-4.0", "CC-BY-SA-4.0")} | {"short": "as is", "own": prose(r, 30)}
    rows = []
    for i in range(60):
        w = split(r.choice(list(known.values())))
        how = i % 5
        if how == 1:  # a word more after every third
            w = [y for j, x in enumerate(w) for y in ([x, "indeed"] if j % 3 == 2 else [x])]
        elif how == 2:  # some words less
            w = [x for x in w if r.random() < 0.9]
        elif how == 3:  # some replaced
            w = [x if r.random() < 0.92 else "other" for x in w]
        elif how == 4:  # some more, less, moved
            w = [y for x in w for y in ([x] if r.random() < 0.8 else r.choice([[], [x, "and"], ["so", x]]))]
        rows.append((i, f"{prose(r, r.randint(0, 8))} {' '.join(w)} {prose(r, r.randint(0, 8))}"))
    got = license_scan.find_licenses(table(spark, rows), license_scan.templates(spark, known)).collect()
    wanted = licenses_by_force(rows, known)
    assert {tuple(x) for x in got} == wanted and len(got) == len(wanted) > 30
    mit = [x for x in wanted if x[1] == "MIT" and x[0] % 5 == 1]
    assert all(x[5] > 0.98 for x in mit)  # a span ends where the template would, so the last word may be beyond


def test_licenses_of_a_folder(spark, tmp_path):
    r = random.Random(24)
    texts = {"Long-1.0": prose(r, 3000), "Mine 2": prose(r, 12)}
    (tmp_path / "Long-1.0.txt").write_text(texts["Long-1.0"])
    (tmp_path / "Mine 2").write_text(texts["Mine 2"])
    known = license_scan.templates_of_folder(spark, f"file://{tmp_path}")
    assert {x.license: x.text for x in known.collect()} == texts
    got = license_scan.find_licenses(table(spark, [(1, "as " + texts["Long-1.0"]), (2, texts["Mine 2"])]), known).collect()
    assert sorted((x.doc_id, x.license, x.first_word, x.similarity) for x in got) == [(1, "Long-1.0", 1, 1), (2, "Mine 2", 0, 1)]


def leaks_by_force(docs, items, threshold=0.5, match=5):
    out = {}
    texts = [(i, w, {tuple(w[a : a + match]) for a in range(len(w) - match + 1)}) for i, t in items if len(w := split(t)) >= match]
    for d, text in docs:
        w = split(text)
        held = {tuple(w[a : a + match]) for a in range(len(w) - match + 1)}
        for i, item, seeds in texts:
            if held & seeds:
                # Only what the item has can be covered; the rest is one word between.
                near = {x for a in range(len(w) - match + 1) if tuple(w[a : a + match]) in seeds for x in range(a, a + match)}
                short = [w[x] if x in near else None for x in range(len(w)) if x in near or x - 1 in near]
                covered = tiles_by_force(item, short, match) / len(item)
                if covered >= threshold:
                    out[d, i] = max(covered, out.get((d, i), 0))
    return out


@needs_data
def test_leak_query_against_force(spark):
    docs = [tuple(x) for x in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(x) for x in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(x.doc_id, x.item_id): x.coverage for x in queries.op5_decontaminate(spark, str(DATA)).collect()}
    assert got == pytest.approx(leaks_by_force(docs, items)) and got


def test_ids_of_text(spark):
    r = random.Random(25)
    a, b = prose(r, 40), prose(r, 40)
    mit = license_scan.TEMPLATES["MIT"]
    rows = [("<u:9>", a), ("<u:10>", a), ("<u:11>", a + " more"), ("z", b), (None, a), ("y", mit + " " + b)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert {x.doc_id: x.group_id for x in near_dup.near_duplicates(docs).collect()} == {"<u:9>": "<u:10>", "<u:10>": "<u:10>", "<u:11>": "<u:10>"}
    assert sorted(x.doc_id for x in near_dup.drop_near_duplicates(docs).collect()) == ["<u:10>", "y", "z"]
    bench = spark.createDataFrame([("q-1", b), (None, a)], "item_id string, text string")
    assert sorted((x.doc_id, x.item_id) for x in decontaminate.find_leaks(docs, bench).collect()) == [("y", "q-1"), ("z", "q-1")]
    assert sorted(x.doc_id or "" for x in decontaminate.drop_leaks(docs, bench).collect()) == ["", "<u:10>", "<u:11>", "<u:9>"]
    assert [(x.doc_id, x.license) for x in license_scan.find_licenses(docs, license_scan.templates(spark)).collect()] == [("y", "MIT")]
    vectors = spark.createDataFrame([("b", [0.0]), ("a", [1.0]), ("c", [1.0]), ("d", [5.0])], "vec_id string, embedding array<double>")
    got = [tuple(x) for x in topk.nearest_neighbours(vectors, 2, queries=vectors.vec_id.isin("b", "c")).orderBy("vec_id", "rank").collect()]
    assert got == [("b", 1, "a", 1.0), ("b", 2, "c", 1.0), ("c", 1, "a", 0.0), ("c", 2, "b", 1.0)]


@pytest.mark.parametrize("block, pivots", [(8192, None), (16, 4), (8, 30)])
def test_top_k_of_some_queries(spark, block, pivots):
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=(80, 8)) + 9 * (np.arange(80) % 4)[:, None], np.tile(r.normal(size=8), (40, 1))])
    x = x * 1000 + 5000  # norms at which rounding of products is far above that of the distances
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for g in topk.nearest_neighbours(vectors, 6, pivots, block, queries=vectors.vec_id % 20 == 0).orderBy("vec_id", "rank").collect():
        got.setdefault(g.vec_id, []).append(g.neighbour_id)
    exact = {i: [j for _, j in sorted((float(np.sqrt(((x[j] - x[i]) ** 2).sum())), j) for j in range(len(x)) if j != i)[:6]] for i in range(0, len(x), 20)}
    assert got == exact


@needs_vocabulary
def test_token_files_written_twice(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(20)], "doc_id long, text string").repartition(2)
    folder = f"file://{tmp_path}/files"
    first = sorted(map(tuple, token_counts.write_token_files(docs, queries.VOCABULARY, folder, queries.END_OF_DOCUMENT).collect()))
    before = {p.name: p.read_bytes() for p in (tmp_path / "files").iterdir() if not p.name.endswith(".crc")}
    again = sorted(map(tuple, token_counts.write_token_files(docs, queries.VOCABULARY, folder, queries.END_OF_DOCUMENT).collect()))
    after = {p.name: p.read_bytes() for p in (tmp_path / "files").iterdir() if not p.name.endswith(".crc")}
    assert first == again and before == after and len(after) == 2

    class Refusing:
        """A file system on which a name can't be given twice, and on which another attempt comes between."""

        def __init__(self, system, target):
            self.system, self.target = system, target

        def move(self, a, b):
            Path(self.target).write_bytes(Path(a).read_bytes())
            raise OSError("exists")

        def __getattr__(self, name):
            return getattr(self.system, name)

    from pyarrow import fs

    (tmp_path / "new").write_bytes(b"abcd")
    target = str(tmp_path / "part")
    token_counts._publish(Refusing(fs.LocalFileSystem(), target), str(tmp_path / "new"), target)
    assert Path(target).read_bytes() == b"abcd" and not (tmp_path / "new").exists()
    (tmp_path / "new").write_bytes(b"other bytes")
    with pytest.raises(OSError):
        token_counts._publish(fs.LocalFileSystem(), str(tmp_path / "new"), target)


def test_shards_under_a_prefix(spark):
    df = spark.createDataFrame([(i, True) for i in range(50)], "doc_id long, moved boolean")
    got = sharding.assign_shards(df, ["doc_id"], 7, 3, prefix="place")
    assert got.columns == ["doc_id", "moved", "place", "place_after"]
    assert all(x.moved == (x.place != x.place_after) for x in got.collect())


def model_by_force(texts, good):
    """The classifier fitted in one process by the formulas of its module's docstring."""
    x = quality.features(pa.array(texts, pa.string())).astype(float)
    use = x.any(1)
    u, p = x[use], x[use & good]
    mean, scale = u.mean(0), u.std(0) + 0.1
    words = lambda x: np.expm1(x[:, quality._N : quality._N + 1])
    z = lambda x: np.concatenate([np.clip((x - mean) / scale, -8, 8) * (words(x) / (words(x) + quality.SHRINK)), np.ones((len(x), 1))], 1)
    s = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
    zu, zp = z(u), z(p)

    def descend(n, gradient, w):
        m, v = 0, 0
        for t in range(1, n + 1):
            g = gradient(w) + 1e-3 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        return w

    held = quality.held_out(p)
    fit = zp[~held]
    w = descend(12, lambda w: zu.T @ s(zu @ w) / len(zu) - fit.T @ (1 - s(fit @ w)) / len(fit), np.zeros(zu.shape[1]))
    count = lambda z: np.bincount(np.clip(((1 - s(z @ w)) * 400).astype(int), 0, 399), minlength=400)
    prior = quality.estimate_prior(count(zp[held]), count(zu))

    def gradient(w):
        su, sp = s(zu @ w), s(zp @ w)
        g_u, g_p = zu.T @ (su * (1 - su)) / len(zu), zp.T @ (sp * (1 - sp)) / len(zp)
        return g_u - 2 * prior * g_p if su.mean() - prior * sp.mean() >= 0 else prior * g_p - g_u

    score = z(x) @ descend(24, gradient, w)  # the second fit starts where the first ended
    return np.where(use, score, -np.inf)


@needs_data
@needs_vocabulary
def test_pipeline_against_force(spark):
    """Rows of run() from plain loops over all documents: a fit in memory, all pairs, all positions, all windows, and the public encoder."""
    import tiktoken

    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    labels = {}
    for x in spark.read.parquet(f"{DATA}/labels.parquet").collect():
        labels.setdefault(x.doc_id, []).append(x.quality)
    items = [tuple(x) for x in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    score = model_by_force([t for _, t in docs], np.array([i in labels and min(labels[i]) == 1 for i, _ in docs]))
    assert (np.abs(score) > 1e-4).all()
    scores = {x.doc_id: x.score for x in queries.op4_quality(spark, str(DATA)).collect()}
    assert all(abs(scores[i] - v) < 1e-3 for (i, _), v in zip(docs, score) if np.isfinite(v))
    docs = [x for x, v in zip(docs, score) if v >= 0]
    groups = groups_by_force(docs, 0.55)
    docs = [(i, t) for i, t in docs if groups.get(i, i) == i]
    leaked = {d for d, _ in leaks_by_force(docs, items)}
    docs = [(i, t) for i, t in docs if i not in leaked]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.VOCABULARY, "rb"))}
    public = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = {}
    for i, t in docs:
        if not re.search(secrets.WORDS, t):
            for a, b, _ in reversed(secrets_by_force(t)):
                t = t[:a] + "[SECRET]" + t[b:]
            wanted[i] = public.encode_ordinary(t)
    got = {x.doc_id: x.token_ids for x in corpus_pipeline.run(spark, str(DATA)).collect()}
    assert set(got) == {i for i, _ in docs}
    assert {i: got[i] for i in wanted} == wanted and len(wanted) > 0.8 * len(got)
