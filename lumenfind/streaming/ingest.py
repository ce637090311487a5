"""Indexing documents as they arrive: each micro-batch is a commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import DocumentIndex


def index_stream(index: DocumentIndex, docs: DataFrame, columns: dict[str, str], checkpoint: str, doc_id: str = "doc_id", **trigger) -> StreamingQuery:
    """Starts a query that adds each micro-batch of ``docs`` to the index and commits it.

    A commit writes what is new and no more, and small segments merge as they gather. Postings are a set, so a batch that runs again after a failure changes nothing. Pass ``availableNow=True`` to
    take what is there and stop.
    """

    def add(batch: DataFrame, _: int) -> None:
        index.rollback()  # what a batch that failed has left
        index.add_documents(batch, columns, doc_id)
        index.commit()

    writer = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
