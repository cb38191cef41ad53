"""Captions for a stream of query vectors, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lanternfish.operators.retrieve import basic


def caption_stream(queries: DataFrame, index: DataFrame, sink: str, checkpoint: str, mode: str = "medoid") -> StreamingQuery:
    """Write (query_id, caption, distance, mode, batch_id) of each batch under ``sink``; a batch that runs again
    overwrites its own folder, so each query is answered once."""

    def answer(batch: DataFrame, batch_id: int) -> None:
        basic(batch, index, mode).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
