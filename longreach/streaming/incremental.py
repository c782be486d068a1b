"""Incremental runs: new files pass through an operator once, and finished batches are never redone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery


def run_incrementally(spark: SparkSession, source: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, fmt: str = "json") -> StreamingQuery:
    """Reads what is new in ``source``, applies ``transform`` to it and adds the rows to ``sink``, then stops.

    Each batch goes into a folder of its own, overwritten if the batch is run again after a failure, so every input row
    is in the output exactly once."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window_start, by, n): rows per window, for streams with a watermark of ``late`` and for tables alike. An
    extension: rows without a time are left out."""
    rows = events.where(F.col(time).isNotNull())
    if events.isStreaming:
        rows = rows.withWatermark(time, late)
    return rows.groupBy(F.window(time, width).alias("w"), F.col(by)).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")
