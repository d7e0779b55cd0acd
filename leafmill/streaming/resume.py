"""Books as a stream: new archives are translated in micro-batches, and an interrupted run takes up where it stopped.

The stream's checkpoint knows which archives are done; within a batch the cache knows which documents are. A batch that is
run again therefore asks the model only for what is missing, and writes the same archives.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Options, translate
from ..sources.books import stream_books


def translate_stream(spark: SparkSession, folder: str, o: Options, checkpoint: str, reports: str | None = None, per_batch: int = 16) -> StreamingQuery:
    """Translates all archives in `folder` that the checkpoint hasn't seen, `per_batch` at a time, then stops. Reports are appended to a Parquet folder."""
    stream = stream_books(spark, folder, per_batch)
    placed = o if o.root is not None else replace(o, root=folder.rstrip("/") + "/")  # a batch's own books don't say where outputs go

    def batch(rows: DataFrame, number: int) -> None:
        out = translate(rows, placed)
        if reports:
            out.reports.write.mode("overwrite").parquet(f"{reports.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
