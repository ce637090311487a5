"""Transaction assembly: the records of one capture, joined through their concurrent-to identifiers.

Records are rows ``(record_id, record_type, concurrent_to, target_uri, payload)``. What the identifiers connect,
directly or through other records and in either direction, is one capture. Identifiers alone decide that: components are found
on pairs of identifiers, and payloads of responses, the bulk of any archive, are shuffled once, to where the rest of their capture joins them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch, connected_components

#: Record types that hold what a server sent; the others describe or ask for it.
RESPONSES = ("response", "resource", "revisit")
FIELDS = ("record_id", "record_type", "target_uri", "payload")


def pages_to_records(pages: DataFrame) -> DataFrame:
    """Records as a crawler writes them: per page a response, a request concurrent to it, and metadata concurrent to the request."""

    def name(kind: str):
        return F.concat(F.lit("urn:md5:"), F.md5(F.concat_ws("|", F.lit(kind), F.col("page_id").cast("string"), F.coalesce("url", F.lit("")))))

    none = F.array().cast("array<string>")
    response = F.struct(name("response").alias("record_id"), F.lit("response").alias("record_type"), none.alias("concurrent_to"), F.col("url").alias("target_uri"), F.col("html").alias("payload"))
    request = F.struct(name("request"), F.lit("request"), F.array(name("response")), F.col("url"), F.concat(F.lit("GET "), F.coalesce("url", F.lit("")), F.lit(" HTTP/1.1")))
    metadata = F.struct(name("metadata"), F.lit("metadata"), F.array(name("request")), F.col("url"), F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("; length: "), F.length(F.coalesce("html", F.lit(""))).cast("string")))
    # Three narrow selects rather than one explode: the page text then is in one of them only.
    parts = [pages.where("page_id IS NOT NULL").select(p.alias("r")) for p in (response, request, metadata)]
    out = parts[0].select("r.*")
    for p in parts[1:]:
        out = out.union(p.select("r.*"))
    return out


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: ``(capture_id, target_uri, n_records, response, requests, metadata, others)``.

    ``response`` is the capture's response record (of several the one of least id; the rest are among ``others``),
    null if it has none; ``requests``, ``metadata`` and ``others`` are arrays of records in the order of their ids. ``capture_id``
    is the id of the response, or else the least id of the capture's records, ``target_uri`` that of the response, or else the least.

    A record without concurrent-to identifiers that no other names is a capture of its own. Identifiers that
    no record has connect the records that name them. Records with a null id are left out; null, empty and
    repeated concurrent-to entries, and those that name their own record, connect nothing. An id that repeats counts once, with its
    least record (by type, URI and payload), but links of all its rows hold. Null types are among
    ``others``; null, empty and very long payloads are kept as they are. An empty table gives an empty result;
    other columns are dropped.
    """
    s = Scratch(records.sparkSession, "warc")
    named = records.where(F.col("record_id").isNotNull())
    edges = named.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b")).where("b <> ''")
    roots = connected_components(edges, s)
    kind = F.coalesce(F.col("record_type"), F.lit(""))
    ids = named.select("record_id", kind.isin(*RESPONSES).alias("is_response")).distinct()
    rooted = ids.join(roots.select(F.col("node").alias("record_id"), "root"), "record_id", "left").withColumn("root", F.coalesce("root", "record_id"))
    least = F.coalesce(F.min(F.when(F.col("is_response"), F.col("record_id"))), F.min("record_id")).alias("capture_id")
    captures = s.keep(rooted.select("record_id", "root").distinct().join(rooted.groupBy("root").agg(least), "root").select("record_id", "capture_id", (F.col("record_id") == F.col("capture_id")).alias("names_it")), "captures")

    row = F.row_number().over(Window.partitionBy("record_id").orderBy(F.col("record_type").asc_nulls_last(), "target_uri", "payload"))
    once = named.select(*FIELDS).withColumn("__row", row).where("__row = 1").drop("__row")
    # Whether a record names its capture is read as a flag: as an equality it would become a key of the join, and
    # payloads would be shuffled again. So all of them move once, to their record ids, and responses stay there.
    placed = once.join(captures, "record_id")
    record = F.struct(*FIELDS)
    main = placed.where(F.col("names_it") & kind.isin(*RESPONSES)).select(F.col("record_id").alias("id"), record.alias("response"))
    rest = placed.where(~F.col("names_it") | ~kind.isin(*RESPONSES))
    listed = rest.groupBy("capture_id").agg(F.sort_array(F.collect_list(record)).alias("records"))
    both = main.join(listed, F.col("id") == F.col("capture_id"), "full_outer")
    records_ = F.coalesce("records", F.array().cast(listed.schema["records"].dataType))

    def of(kind: str):
        return F.filter(records_, lambda r: F.coalesce(r["record_type"] == kind, F.lit(False))).alias(kind + "s" if kind == "request" else kind)

    others = F.filter(records_, lambda r: ~F.coalesce(r["record_type"].isin("request", "metadata"), F.lit(False)))
    return both.select(
        F.coalesce("id", "capture_id").alias("capture_id"),
        F.coalesce(F.col("response.target_uri"), F.array_min(F.transform(records_, lambda r: r["target_uri"]))).alias("target_uri"),
        (F.size(records_) + F.col("id").isNotNull().cast("int")).alias("n_records"),
        "response",
        of("request"),
        of("metadata"),
        others.alias("others"),
    )
