"""Incremental indexing: chunk files that arrive in a folder are indexed batch by batch, each id once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plugins import Embedder
from ..schema import CHUNK
from ..sources.store import VectorStore, index_chunks


def index_stream(spark: SparkSession, folder: str, store: VectorStore, model: Callable[[], Embedder], checkpoint: str, max_files: int = 100) -> StreamingQuery:
    """Index what arrives, then stop at the end of what is there. A batch that is run again adds nothing: ids are inserted if absent, and the
    store's log knows the stream's last batch."""
    arriving = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", max_files).json(folder)

    def batch(df, number):
        index_chunks(store, df, model, writer=f"stream {checkpoint}", batch=number)

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
