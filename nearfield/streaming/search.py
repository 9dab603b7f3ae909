"""Streams of records and queries.

Filters are free of state, so they run on streams as on tables. Ingestion appends each micro-batch to a
folder of Parquet; a query stream searches a collection batch by batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nearfield.operators.collection import Collection
from nearfield.plans.compile import TypedFields, to_column
from nearfield.plans.filters import parse


def filtered(stream: DataFrame, condition: str) -> DataFrame:
    return stream.where(to_column(parse(condition), TypedFields(stream.schema)))


def ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the records of a stream to a folder, each once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def answer(queries: DataFrame, collection: Collection, k: int, metric: str, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the k nearest records of each query of a stream (query_id, query_vector), a folder a batch."""

    def run(batch: DataFrame, number: int) -> None:
        # A repeated batch overwrites what its first try left.
        collection.search_batch(batch, k, metric).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
