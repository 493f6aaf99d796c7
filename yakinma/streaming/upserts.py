"""The crawler's change events as a stream: each micro-batch is merged into the stored table.

Arrival decides: a later batch wins over an earlier one whatever its times say, within a batch the scrape time does.
A batch that is replayed after a failure merges to the same state, so at-least-once delivery is enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from yakinma.schema import CRAWL_ITEMS
from yakinma.sources.store import Store


def crawl_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(CRAWL_ITEMS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_upserts(events: DataFrame, store: Store, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Merge every micro-batch; without an interval everything available is taken and the query ends."""

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.upsert(batch)

    w = events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()
