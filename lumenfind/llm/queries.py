"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, license_scan, near_dup, quality, secrets, sharding, token_counts, topk, warc

#: A rank file of a public byte-level vocabulary; every executor must see it at this path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50256
NEIGHBOURS = 10
SHARDS, APPENDED = 1000, 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested rows; structs as JSON, so that any engine's rows can be held against them."""
    captures = warc.assemble(warc.pages_to_records(table(spark, sf_dir, "pages")))
    nested = [F.to_json(c).alias(c) for c in ("response", "requests", "metadata", "others")]
    return captures.select("capture_id", "target_uri", "n_records", *nested)


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_document_tokens(table(spark, sf_dir, "documents"), VOCABULARY, END_OF_DOCUMENT)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find_licenses(table(spark, sf_dir, "documents"), license_scan.templates(spark))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries, every vector whose id 20 divides, against all vectors."""
    return topk.nearest_neighbours(table(spark, sf_dir, "embeddings"), NEIGHBOURS, queries=F.col("vec_id") % 20 == 0)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign_shards(docs, ["doc_id"], SHARDS, APPENDED)


QUERIES = {f.__name__: f for f in (op1_warc, op2_near_dup, op3_bpe, op4_quality, op5_decontaminate, op6_token_counts, op7_licenses, op8_topk, op9_secrets, op10_sharding)}

_JUMP = """
{name}(doc_id, key, b, j) AS (
  SELECT doc_id, key::HUGEINT, -1::BIGINT, 0::BIGINT FROM keys
  UNION ALL
  SELECT doc_id, k2, j, floor((j + 1) * (2147483648.0::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT doc_id, j, (key * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM {name} WHERE j < {n})
)"""

ORACLE_SQL = {
    "op1_warc": """
WITH p AS (SELECT *, 'urn:md5:' || md5('response|' || page_id || '|' || url) AS a, 'urn:md5:' || md5('request|' || page_id || '|' || url) AS b,
  'urn:md5:' || md5('metadata|' || page_id || '|' || url) AS c FROM pages)
SELECT a AS capture_id, url AS target_uri, 3::INTEGER AS n_records,
  to_json({'record_id': a, 'record_type': 'response', 'target_uri': url, 'payload': html})::VARCHAR AS response,
  to_json([{'record_id': b, 'record_type': 'request', 'target_uri': url, 'payload': 'GET ' || url || ' HTTP/1.1'}])::VARCHAR AS requests,
  to_json([{'record_id': c, 'record_type': 'metadata', 'target_uri': url, 'payload': 'page-id: ' || page_id || '; length: ' || length(html)}])::VARCHAR AS metadata,
  '[]' AS others
FROM p""",
    # Groups of all pairs by exact similarity, without sketches or candidates.
    "op2_near_dup": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, * FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text <> '')),
w AS (SELECT k, regexp_extract_all(regexp_replace(lower(text), '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])', ' \1 ', 'g'), '[\p{L}\p{M}\p{N}]+') AS w FROM d),
g AS (SELECT DISTINCT k, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT k, count(*) AS n FROM g GROUP BY k),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS s FROM g a JOIN g b ON a.g = b.g AND a.k < b.k GROUP BY a.k, b.k),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM p JOIN n m ON m.k = a JOIN n o ON o.k = b JOIN d x ON x.k = a JOIN d y ON y.k = b WHERE s >= 0.55 * (m.n + o.n - s) - 1e-9
  UNION SELECT x.doc_id, y.doc_id FROM d x JOIN d y ON x.text = y.text),
both_ways AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, x.b FROM r JOIN both_ways x ON r.b = x.a)
SELECT a AS doc_id, least(a, min(b)) AS group_id FROM r GROUP BY a""",
    "op8_topk": f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS neighbour_id, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour_id)::INTEGER AS rank FROM d)
SELECT vec_id, rank, neighbour_id, round(d, 5) AS distance FROM r WHERE rank <= {NEIGHBOURS}""",
    "op10_sharding": f"""
WITH RECURSIVE keys AS (
  SELECT doc_id, ('0x' || substr(md5(length(doc_id::VARCHAR) || ':' || doc_id::VARCHAR), 1, 16))::UBIGINT AS key FROM documents
), {_JUMP.format(name="before_", n=SHARDS)}, {_JUMP.format(name="after_", n=SHARDS + APPENDED)},
a AS (SELECT doc_id, max(j)::INTEGER AS shard FROM before_ WHERE j < {SHARDS} GROUP BY doc_id),
b AS (SELECT doc_id, max(j)::INTEGER AS shard_after FROM after_ WHERE j < {SHARDS + APPENDED} GROUP BY doc_id)
SELECT doc_id, shard, shard_after, shard <> shard_after AS moved FROM a JOIN b USING (doc_id)""",
}
