"""Session logs as a stream: files that arrive are indexed by the same plan as in a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from retrospark.config import Settings
from retrospark.embeddings import Provider
from retrospark.plans.indexer import Store, update

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def follow(store: Store, root: str, checkpoint: str, provider: Provider | None = None, settings: Settings = Settings(), once: bool = True, interval: str = "1 minute") -> StreamingQuery:
    """Start a query that brings the index up to date when files arrive: once for what is there, or from time to time.

    The stream only tells that there is something new; which sessions changed is found by hash and size, so a batch that
    is delivered again changes nothing.
    """
    files = store.spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root)

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            update(store, root, provider=provider, settings=settings)

    writer = files.select("path").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
