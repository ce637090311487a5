"""The document index: postings, dictionary and documents per field, as DataFrames and Parquet.

``postings(field, term, term_num, doc_id)`` is a set; text terms are in ``term``, numbers in ``term_num``. On disk it is
a sequence of segments. Each has its postings, the number of documents of each of its terms, and the documents that
no earlier segment knows, partitioned by field and by a hash bucket of the term and sorted by term within files: a lookup opens one bucket a
segment, and there a few row groups. A segment has as many buckets as its size asks for, and a bucket as many files.

A commit writes one segment and no more: it reads of the old ones only the ids of documents, and the postings of
those that come again. Segments of like size merge, so that there are few, and each posting is written a logarithmic number of times. What
the index consists of is in a numbered manifest, which appears at once when all else is written.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from functools import reduce
from itertools import groupby
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.pipeline import Bucket, IndexPipeline, Pipeline, QueryPipeline, run_steps, terms
from ..schema import DocumentSchema, FieldDef, FieldGroup, Supplement
from ..sources import folders

POSTINGS = "field string, term string, term_num decimal(20,0), doc_id long"
DICTIONARY = "field string, term string, term_num decimal(20,0), df long"
DOCS = "field string, doc_id long"
KEYS = ["field", "term", "term_num"]
#: Bytes of documents for each bucket of a segment, the most buckets, and the bytes up to which a table is dealt to all cores.
BUCKET_BYTES, MOST_BUCKETS, SMALL_BYTES = 256 << 20, 1 << 14, 16 << 20
#: Bytes of texts in a task that makes postings distinct, and of documents above which tasks within buckets follow from bytes.
TASK_BYTES, SPLIT_BYTES = 8 << 20, 64 << 20
#: Documents that are sent to all tasks at most.
FEW = 1_000_000
#: Neighbouring segments of like size that merge, each up to this many times as large as another.
FANOUT = 8

Term = tuple[str, str]


def default_idf(n_docs: Column, df: Column) -> Column:
    """ln(1 + N / df): positive for any term that occurs, also if every document has it."""
    return F.log(1 + n_docs / df)


def term_key(term: str = "term", number: str = "term_num") -> Column:
    """One text for both kinds of terms; within a field it is unambiguous."""
    return F.coalesce(F.col(term), F.col(number).cast("string"))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(key), F.lit(buckets)).cast("int").alias("bucket")


def bucket_number(term: str, buckets: int) -> int:
    """The same on the driver."""
    return zlib.crc32(term.encode()) % buckets


@dataclass(frozen=True)
class Segment:
    """Files of one commit or merge: its postings, and for each field the documents that it has first."""

    name: str
    buckets: int
    rows: int
    n_docs: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Added:
    """Postings of a field, as they come from its pipeline; ``gathered`` are the same, of a document all in one of so many ``tasks`` if a pipeline made them."""

    field: str
    plain: DataFrame
    gathered: DataFrame
    tasks: int | None = None


class FieldBucket(Bucket):
    """A sink for token streams: a field of an index."""

    def __init__(self, index: DocumentIndex, name: str):
        self.index, self.name = index, name

    def put(self, stream: DataFrame) -> None:
        rows = stream.select("term", "term_num", F.col("doc_id").cast("long").alias("doc_id"))
        self.index._buffer.append(Added(self.name, rows, rows))


class DocumentIndex:
    """An index over the fields of a schema; add documents, commit, query.

    What is added shows from the next commit on. Without ``base_path`` the index lives in the session alone.
    ``buckets`` fixes the number of buckets of new segments, which else follows from the size of what is added.
    """

    def __init__(self, spark: SparkSession, schema: DocumentSchema, base_path: str | None = None, buckets: int | None = None, idf: Callable[[Column, Column], Column] = default_idf):
        self.spark, self.schema, self.base_path, self.buckets, self.idf = spark, schema, base_path, buckets, idf
        self._buffer: list[Added] = []
        self._held: list[Added] = []  # what an index without files was made of
        self._segments: list[Segment] = []
        self._version = self._next = 0
        self._obsolete: list[str] = []
        self._memory: DataFrame | None = None  # postings that are not read from files, for lookups: conditions on terms reach the texts
        self._full: DataFrame | None = None  # the same, to be read as a whole
        self._found: tuple[set[Term], DataFrame] | None = None  # those of the last query's terms
        self._counted: DataFrame | None = None  # their dictionary, if they are kept
        self._n_docs: dict[str, int] | None = None
        self._external: DataFrame | None = None
        self._external_name: str | None = None
        self._sources: dict[str, str] = {}
        self._query_source: str | None = None
        self._query_pipeline: QueryPipeline | Callable[[DataFrame], DataFrame] | None = None
        self.pipelines: dict[str, IndexPipeline] = {}

    # Creation, loading

    @classmethod
    def create(cls, spark: SparkSession, schema: DocumentSchema, base_path: str | None = None, **options) -> DocumentIndex:
        """An empty index; driver only, no job."""
        return cls(spark, schema, base_path, **options)

    @classmethod
    def load(cls, spark: SparkSession, base_path: str, **options) -> DocumentIndex:
        """The index as of its last complete commit, with its external ids and the pipelines that were given as text."""
        versions = _versions(spark, base_path)
        if not versions:
            raise FileNotFoundError(f"no index in {base_path}")
        meta = json.loads(folders.read_text(spark, _manifest(base_path, versions[-1])))
        schema = DocumentSchema(external_id=meta["external_id"])
        for g in meta["groups"]:
            schema.add(FieldGroup(**g))
        for f in meta["fields"]:
            schema.add(FieldDef(**{**f, "supplement": Supplement(f["supplement"])}))
        index = cls(spark, schema, base_path, **{"buckets": meta["buckets"], **options})
        index._segments = [Segment(**s) for s in meta["segments"]]
        index._version, index._next, index._obsolete = versions[-1], meta["next"], meta["obsolete"]
        if meta["external"]:
            index._external_name = meta["external"]
            index._external = spark.read.parquet(f"{base_path}/{meta['external']}")
        for source in meta["pipelines"].values():
            index.set_pipeline(source)
        if meta["query_pipeline"]:
            index.set_query_pipeline(meta["query_pipeline"])
        return index

    def add_field(self, group: str, name: str, supplement: Supplement = Supplement.NONE, term_doc_ratio: float = 1.0) -> FieldDef:
        return self.schema.add_field(group, name, supplement, term_doc_ratio)

    # Indexing

    def set_pipeline(self, pipeline: str | IndexPipeline, field: str | None = None) -> IndexPipeline:
        """The pipeline of a field: text that names its field, a Pipeline, or, with ``field``, any function from ``(doc_id, token)`` rows
        with whole texts to ``(doc_id, term)`` rows or to rows of several fields, ``(field, doc_id, term)``. The last one set holds."""
        if isinstance(pipeline, str):
            parsed = Pipeline.parse(pipeline).check(self.schema.targets())
            self._sources[parsed.field] = pipeline
        else:
            parsed = pipeline.check(self.schema.targets()) if isinstance(pipeline, Pipeline) else pipeline
            if not isinstance(parsed, Pipeline) and field not in self.schema.fields:
                raise ValueError("a function needs the field that it is for")
            self._sources.pop(field if field is not None else parsed.field, None)
        self.pipelines[field if field is not None else parsed.field] = parsed
        return parsed

    def bucket(self, field: str) -> FieldBucket:
        """The field as a sink of token streams."""
        return FieldBucket(self, self.schema.fields[field].name)

    def add_documents(self, docs: DataFrame, columns: dict[str, str], doc_id: str = "doc_id") -> None:
        """Runs the pipelines of the fields named in ``columns`` (field to text column) over ``docs``. Null texts give no terms."""
        docs = docs.select(doc_id, *dict.fromkeys(columns.values()))
        spread, tasks = over_all_cores(docs), tasks_for(docs)
        # A cast to what it is already would keep branches from sharing one shuffle.
        key = F.col(doc_id) if (doc_id, docs.schema[doc_id].dataType.simpleString()) == ("doc_id", "bigint") else F.col(doc_id).cast("long").alias("doc_id")
        for name, column in columns.items():
            plain, whole = (df.select(key, F.col(column).cast("string").alias("token")) for df in (spread, docs))
            streams = zip(self._streams(name, plain), self._streams(name, whole.repartition(tasks, "doc_id")), strict=True)
            self._buffer += [Added(f, rows, gathered, tasks) for (f, rows), (_, gathered) in streams]

    def _streams(self, name: str, texts: DataFrame) -> list[tuple[str, DataFrame]]:
        """The postings that a field's pipeline makes of texts, with the field that they are for."""
        pipeline = self.pipelines[name]
        if isinstance(pipeline, Pipeline):
            return [(f, terms(rows).select("term", "term_num", "doc_id")) for f, rows in run_steps(list(pipeline.steps), pipeline.field, texts)]
        out = pipeline(texts)
        if "field" not in out.columns:
            return [(name, self._encoded(name, out))]
        return [(f, self._encoded(f, out.where(F.col("field") == f))) for f in self.schema.fields]

    def _encoded(self, field: str, rows: DataFrame) -> DataFrame:
        text, num = self.schema.fields[field].encode(F.col("term"))
        return rows.where("term IS NOT NULL").select(text.alias("term"), num.alias("term_num"), F.col("doc_id").cast("long").alias("doc_id"))

    def put(self, field: str, terms: DataFrame) -> None:
        """Adds ``(doc_id, term)`` rows to a field without a pipeline. Terms are of the field's type; null ones are left out."""
        self.bucket(field).put(self._encoded(field, terms))

    def rollback(self) -> None:
        """Forgets what was added since the last commit."""
        self._buffer = []

    def commit(self) -> DocumentIndex:
        """Makes what was added visible. If it fails nothing has changed, and what was added is still there to commit."""
        if not self._buffer:
            return self
        if self.base_path:
            size = bytes_of(reduce(DataFrame.unionByName, (a.plain for a in self._buffer)))
            docs, again = documents_of(self._buffer).persist(), None
            try:
                if self._segments:
                    again = self._read("docs", DOCS).join(docs, ["field", "doc_id"], "left_semi").persist()
                segment = self._write(distinct(self._buffer, self._read("postings", POSTINGS), again), docs if again is None else docs.join(again, ["field", "doc_id"], "left_anti"), self.buckets or buckets_for(size), size is not None and size > SPLIT_BYTES)
            finally:
                docs.unpersist()
                if again is not None:
                    again.unpersist()
            self._publish([*self._segments, segment])
            self.unpersist()
            self._n_docs = None
        else:
            self._held += self._buffer
            self.unpersist()
            self._memory = reduce(DataFrame.unionByName, (valid(a) for a in self._held)).dropDuplicates(["field", "term", "term_num", "doc_id"])
            self._full, self._n_docs = distinct(self._held), None
        self._buffer = []
        if self.base_path:
            self._merge_tiers()
        return self

    def _write(self, new: DataFrame, docs: DataFrame, buckets: int, large: bool) -> Segment:
        """A segment of postings, and of the documents that no other has."""
        name = f"segment-{self._next:06d}"
        self._next += 1
        path = f"{self.base_path}/{name}"

        def store(rows: DataFrame, table: str, *order: str) -> None:
            # Partitions by bucket. Of large ones adaptive execution makes as many tasks as their bytes ask for; where all is small it
            # would make too few to use all cores, and buckets alone are enough.
            by = (F.col("field"), F.col("bucket"))
            rows = (rows.hint("rebalance", *by) if large or buckets > 8 else rows.repartition(*by)).sortWithinPartitions("field", "bucket", *order)
            rows.write.mode("overwrite").partitionBy("field", "bucket").parquet(f"{path}/{table}")

        store(new.select("field", "term", "term_num", "doc_id", bucket_of(term_key(), buckets)), "postings", "term", "term_num", "doc_id")
        written = self.spark.read.schema(POSTINGS + ", bucket int").parquet(f"{path}/postings")
        store(written.groupBy("field", "bucket", "term", "term_num").agg(F.count("*").alias("df")), "dictionary", "term", "term_num")
        docs.hint("rebalance", "field").write.mode("overwrite").partitionBy("field").parquet(f"{path}/docs")
        stored = self.spark.read.schema(DOCS).parquet(f"{path}/docs")
        n_docs = {r.field: r["count"] for r in stored.groupBy("field").count().collect()}
        return Segment(name, buckets, written.count(), n_docs)

    def _publish(self, segments: list[Segment], obsolete: Iterable[str] = ()) -> None:
        """The next manifest; what the one before last alone refers to goes."""
        fields = [{**asdict(f), "supplement": f.supplement.value} for f in self.schema.fields.values()]
        meta = {
            "segments": [asdict(s) for s in segments], "next": self._next, "buckets": self.buckets, "external": self._external_name, "external_id": self.schema.external_id,
            "pipelines": self._sources, "query_pipeline": self._query_source, "fields": fields, "groups": [asdict(g) for g in self.schema.groups.values()], "obsolete": list(obsolete),
        }
        folders.publish_text(self.spark, _manifest(self.base_path, self._version + 1), json.dumps(meta))
        gone, self._obsolete = self._obsolete, list(obsolete)
        self._segments, self._version = list(segments), self._version + 1
        for name in gone:
            folders.delete(self.spark, f"{self.base_path}/{name}")
        for v in _versions(self.spark, self.base_path)[:-2]:
            folders.delete(self.spark, _manifest(self.base_path, v))

    def save_schema(self) -> None:
        """Writes fields, groups, pipelines and ratios as they are now; commits do so too."""
        self._publish(self._segments)

    def merge(self) -> DocumentIndex:
        """All segments as one."""
        if len(self._segments) > 1:
            self._merge(0, len(self._segments))
        return self

    def _merge_tiers(self) -> None:
        """Merges each run of FANOUT neighbouring segments of like size, the smallest first, till there is none."""
        while True:
            tiers = [(t, [i for i, _ in run]) for t, run in groupby(enumerate(self._segments), lambda x: int(log(max(x[1].rows, 1), FANOUT)))]
            full = [(t, at) for t, at in tiers if len(at) >= FANOUT]
            if not full:
                return
            _, at = min(full)
            self._merge(at[0], at[-1] + 1)

    def _merge(self, first: int, last: int) -> None:
        old = self._segments[first:last]
        rows = sum(s.rows for s in old)
        most = max(old, key=lambda s: s.rows)
        buckets = self.buckets or min(MOST_BUCKETS, max(1, round(most.buckets * rows / max(most.rows, 1))))
        # Postings of segments don't overlap, nor do their new documents.
        new = self._write(self._read("postings", POSTINGS, old), self._read("docs", DOCS, old), buckets, rows > SPLIT_BYTES // 16)
        self._publish([*self._segments[:first], new, *self._segments[last:]], [s.name for s in old])

    def _read(self, table: str, schema: str, segments: list[Segment] | None = None, terms: list[Term] | None = None) -> DataFrame:
        """A table of some segments, all by default; of some ``terms`` only, of which the buckets alone are opened."""
        parts = []
        for s in self._segments if segments is None else segments:
            df = self.spark.read.schema(schema + (", bucket int" if table != "docs" else "")).parquet(f"{self.base_path}/{s.name}/{table}")
            parts.append(df if terms is None else df.where(self._among(terms, s.buckets)))
        names = [c.split()[0] for c in schema.split(", ")]
        return reduce(DataFrame.unionByName, parts).select(*names) if parts else self.spark.createDataFrame([], schema)

    def _among(self, terms: list[Term], buckets: int | None = None) -> Column:
        """Whether a row is of one of the terms; conditions are plain, so that they reach the scan."""
        out = F.lit(False)
        for f in dict.fromkeys(f for f, _ in terms):
            of_field = list(dict.fromkeys(t for g, t in terms if g == f))
            if self.schema.fields[f].numeric:
                of_field = [str(int(t)) for t in of_field if t.isascii() and t.isdigit() and len(t.lstrip("0")) <= 20]
                hit = F.col("term_num").isin([F.lit(t).cast("decimal(20,0)") for t in of_field])
            else:
                hit = F.col("term").isin(of_field)
            if not of_field:
                continue
            hit = (F.col("field") == f) & hit
            if buckets is not None:
                hit = hit & F.col("bucket").isin(sorted({bucket_number(t, buckets) for t in of_field}))
            out = out | hit
        return out

    def persist(self) -> DocumentIndex:
        """Keeps postings and dictionary in memory, spilling to disk, for many queries in one session."""
        self._memory = self._full = self.postings().persist()
        self._counted = self._found = None
        self._counted = self._count(self._memory).persist()
        return self

    def unpersist(self) -> None:
        """Gives the memory back; an index in files is read from them again."""
        for df in (self._memory, self._counted, self._found[1] if self._found else None):
            if df is not None:
                df.unpersist()
        self._counted = self._found = None
        if self.base_path:
            self._memory = self._full = None

    @staticmethod
    def _count(postings: DataFrame) -> DataFrame:
        return postings.groupBy(*KEYS).agg(F.count("*").alias("df"))

    # Access

    def postings(self, field: str | None = None) -> DataFrame:
        out = self._full if self._full is not None else self._read("postings", POSTINGS)
        return out if field is None else out.where(F.col("field") == field)

    def hits(self, terms: list[Term]) -> DataFrame:
        """The postings of some terms, as ``(field, key, doc_id)``."""
        return self._of(terms).select("field", term_key().alias("key"), "doc_id")

    def _of(self, terms: list[Term]) -> DataFrame:
        if self._found is not None and self._found[0].issuperset(terms):
            return self._found[1].where(self._among(terms))
        return self._memory.where(self._among(terms)) if self._memory is not None else self._read("postings", POSTINGS, terms=terms)

    def look_up(self, terms: list[Term]) -> None:
        """Keeps the postings of a query's terms till the next query, where else each use of them would go through all texts: without files, and not persisted."""
        if self._memory is None or self._counted is not None or self._found is not None and self._found[0].issuperset(terms):
            return
        if self._found is not None:
            self._found[1].unpersist()
        self._found = set(terms), self._memory.where(self._among(terms)).persist()

    def n_docs(self) -> dict[str, int]:
        """Documents with at least one term, per field: of an index in files no job, else counted once a commit."""
        if self._n_docs is None:
            if self._segments:
                self._n_docs = {}
                for s in self._segments:
                    for f, n in s.n_docs.items():
                        self._n_docs[f] = self._n_docs.get(f, 0) + n
            else:
                docs = documents_of(self._held) if self._held else self.postings().select("field", "doc_id").distinct()
                self._n_docs = {r.field: r["count"] for r in docs.groupBy("field").count().collect()}
        return self._n_docs

    def _counts(self, terms: list[Term] | None = None) -> DataFrame:
        """``(field, term, term_num, df)``."""
        if self._memory is not None:
            if self._counted is not None:
                return self._counted if terms is None else self._counted.where(self._among(terms))
            return self._count(self._full if terms is None else self._of(terms))
        out = self._read("dictionary", DICTIONARY, terms=terms)
        return out.groupBy(*KEYS).agg(F.sum("df").alias("df")) if len(self._segments) > 1 else out

    def dictionary(self, field: str | None = None, terms: list[Term] | None = None) -> DataFrame:
        """``(field, term, term_num, df, n_docs, idf, weight)``, of one field or some terms if asked for; the weight is idf / term_doc_ratio."""
        df = self._counts(terms)
        return self.weighted(df if field is None else df.where(F.col("field") == field))

    def weighted(self, counts: DataFrame) -> DataFrame:
        """``n_docs``, ``idf`` and ``weight`` beside a table with ``field`` and ``df``."""
        ratio, n_docs = F.lit(1.0), F.lit(None).cast("long")
        for f in self.schema.fields.values():
            if f.term_doc_ratio != 1.0:
                ratio = F.when(F.col("field") == f.name, float(f.term_doc_ratio)).otherwise(ratio)
        for name, n in self.n_docs().items():
            n_docs = F.when(F.col("field") == name, F.lit(n).cast("long")).otherwise(n_docs)
        return counts.withColumn("n_docs", n_docs).withColumn("idf", self.idf(F.col("n_docs"), F.col("df"))).withColumn("weight", F.col("idf") / ratio)

    def matching(self, table: str, keys: DataFrame) -> DataFrame:
        """``keys``, with ``field`` and ``key`` among their columns, and beside them what ``table`` has of these terms: the ``doc_id`` of "postings",
        or the ``df`` of the "dictionary" (one row a segment). Joins are by plain keys, text as text and numbers as numbers, in files by bucket first."""
        value = "doc_id" if table == "postings" else "df"
        if self._memory is not None:
            sources: list[tuple[DataFrame, int | None]] = [(self._full if table == "postings" else self._counts(), None)]
        else:
            schema = (POSTINGS if table == "postings" else DICTIONARY) + ", bucket int"
            sources = [(self.spark.read.schema(schema).parquet(f"{self.base_path}/{s.name}/{table}"), s.buckets) for s in self._segments]
        parts = []
        for numeric, column, kind in ((False, "term", "string"), (True, "term_num", "decimal(20,0)")):
            names = [f.name for f in self.schema.fields.values() if f.numeric == numeric]
            for rows, buckets in sources if names else []:
                wanted, on = keys.where(F.col("field").isin(names)).withColumn(column, F.col("key").try_cast(kind)), ["field", column]
                if buckets is not None:
                    wanted, on = wanted.withColumn("bucket", bucket_of(F.col("key"), buckets)), ["field", "bucket", column]
                parts.append(rows.where(F.col("field").isin(names)).select(*on, value).join(wanted, on).select(*keys.columns, value))
        return reduce(DataFrame.unionByName, parts) if parts else keys.withColumn(value, F.lit(None).cast("long")).where(F.lit(False))

    def measured_ratio(self, field: str) -> float:
        """The mean number of distinct terms a document has in a field: a value for ``term_doc_ratio``, if one is wanted."""
        row = self._counts().where(F.col("field") == field).agg(F.sum("df").alias("n")).first()
        docs = self.n_docs().get(field, 0)
        return (row.n or 0) / docs if docs else 1.0

    # External ids

    @property
    def external_ids(self) -> DataFrame | None:
        return self._external

    @external_ids.setter
    def external_ids(self, ids: DataFrame) -> None:
        """``(doc_id, ext_id)``; ext_id may be of any type, structs included. An index in files keeps them beside it, at once."""
        doc_id, ext_id = ids.columns
        ids = ids.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ext_id).alias("ext_id"))
        if self.base_path:
            old, self._external_name = self._external_name, f"external-{self._next:06d}"
            self._next += 1
            path = f"{self.base_path}/{self._external_name}"
            # Sorted, so that the ids of a few results are in a few row groups.
            ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(path)
            self._publish(self._segments, [old] if old else [])
            ids = self.spark.read.parquet(path)
        self._external = ids

    def with_external_ids(self, results: DataFrame, of: list[int] | None = None) -> DataFrame:
        """Adds ``ext_id``; a document without one fails the query, as the reference ids are then incomplete. ``of`` are the
        documents of the results, where they are known and few."""
        unknown = F.raise_error(F.concat(F.lit("unknown document id "), F.col("doc_id").cast("string")))
        ids = self._external if of is None else self._external.where(F.col("doc_id").isin(of))
        known = ids.withColumn("__known", F.lit(True))
        out = results.join(known, "doc_id", "left")
        return out.withColumn("ext_id", F.when(F.col("__known"), F.col("ext_id")).otherwise(unknown.cast(self._external.schema["ext_id"].dataType))).drop("__known")

    # Queries

    def set_query_pipeline(self, pipeline: str | QueryPipeline | Callable[[DataFrame], DataFrame]) -> None:
        """The last one set holds."""
        self._query_source = pipeline if isinstance(pipeline, str) else None
        if isinstance(pipeline, str):
            pipeline = QueryPipeline.parse(pipeline)
        self._query_pipeline = pipeline.check(self.schema.targets()) if isinstance(pipeline, QueryPipeline) else pipeline

    @property
    def query_pipeline(self) -> QueryPipeline | Callable[[DataFrame], DataFrame]:
        if self._query_pipeline is None:
            raise RuntimeError("no query pipeline is set")
        return self._query_pipeline

    def run_query(self, query, limit: int | None = None) -> DataFrame:
        from .ranking import run_query

        return run_query(self, query, limit)

    def run_queries(self, queries: DataFrame, limit: int | None = None) -> DataFrame:
        from .ranking import run_queries

        return run_queries(self, queries, limit)

    def explain_query(self, query) -> DataFrame:
        from .query import explain

        return explain(self, query)

    def frequent_terms(self, field: str) -> DataFrame:
        from .facets import frequent_terms

        return frequent_terms(self, field)


def valid(added: Added, gathered: bool = False) -> DataFrame:
    rows = added.gathered if gathered else added.plain
    return rows.where("doc_id IS NOT NULL AND (term IS NOT NULL OR term_num IS NOT NULL)").select(F.lit(added.field).alias("field"), "term", "term_num", "doc_id")


def documents_of(added: list[Added]) -> DataFrame:
    """``(field, doc_id)`` of documents with a term. No posting is made distinct for it."""
    return reduce(DataFrame.unionByName, (valid(a).select("field", "doc_id") for a in added)).distinct()


def distinct(added: list[Added], old: DataFrame | None = None, again: DataFrame | None = None) -> DataFrame:
    """Postings, each once, without those that ``old`` has of the documents in ``again``; no other document can repeat any. They meet by term and document, for
    which texts were dealt out by document: what a single pipeline makes for a field isn't shuffled again, and its old postings come to where it is."""
    parts, few = [], 0 if again is None else again.count()
    keys = ["field", "term", "term_num", "doc_id"]
    for name in dict.fromkeys(a.field for a in added):
        of_field = [a for a in added if a.field == name]
        rows = reduce(DataFrame.unionByName, (valid(a, True) for a in of_field))
        if not few:
            parts.append(rows.dropDuplicates(keys))
            continue
        own, ids = old.where(F.col("field") == name).select(*keys), again.where(F.col("field") == name).select("doc_id")
        to = (of_field[0].tasks or tasks_for(rows), "doc_id")
        own = own.join(F.broadcast(ids), "doc_id", "left_semi").repartition(*to) if few <= FEW else own.repartition(*to).join(ids, "doc_id", "left_semi")
        both = rows.withColumn("old", F.lit(0)).unionByName(own.withColumn("old", F.lit(1)))
        parts.append(both.groupBy(*keys).agg(F.max("old").alias("old")).where("old = 0").drop("old"))
    return reduce(DataFrame.unionByName, parts)


def tasks_for(texts: DataFrame) -> int:
    """Tasks that make postings distinct, each of few enough to hold in memory."""
    return max(texts.sparkSession.sparkContext.defaultParallelism, -(-(bytes_of(texts) or 0) // TASK_BYTES))


def by_document(texts: DataFrame) -> DataFrame:
    """All rows of a document in one task, as many tasks as the texts ask for."""
    return texts.repartition(tasks_for(texts), "doc_id")


def buckets_for(size: int | None) -> int:
    """Buckets by the size of what is read, as the planner knows it without a job; eight if it doesn't."""
    if size is None:
        return 8
    return 1 if size < 1 << 20 else 8 if size <= 8 * BUCKET_BYTES else min(MOST_BUCKETS, -(-size // BUCKET_BYTES))


def bytes_of(df: DataFrame) -> int | None:
    """What the planner takes a table's size for, without a job; None if it has no idea."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 58 else None


def over_all_cores(docs: DataFrame) -> DataFrame:
    """A small table may be a file that one task reads: then it is dealt to all cores before the work begins. A large one stays where it is."""
    size = bytes_of(docs)
    return docs.repartition(docs.sparkSession.sparkContext.defaultParallelism) if size is not None and 1 << 20 <= size <= SMALL_BYTES else docs


def _manifest(base_path: str, version: int) -> str:
    return f"{base_path}/manifest-{version:010d}.json"


def _versions(spark: SparkSession, base_path: str) -> list[int]:
    found = [n for n in folders.names(spark, base_path) if n.startswith("manifest-") and n.endswith(".json")]
    return sorted(int(n[len("manifest-") : -len(".json")]) for n in found)
