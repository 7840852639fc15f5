"""The same checks over arriving files, and windowed counts of scan events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.score import all_smells, quality
from ..sources.corpus import files


def arriving(spark: SparkSession, folder: str, schema: str = "path string, source string") -> DataFrame:
    """Rows of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def score_batches(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]):
    """Score each micro-batch with the batch operators and hand (scores, batch number) to ``sink``; returns the query."""

    def each(batch: DataFrame, number: int) -> None:
        table = files(batch)
        sink(quality(table, all_smells(table)), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "15 seconds", late: str = "1 minute") -> DataFrame:
    """Events per tumbling window and kind, with a watermark; the same on a batch and on a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
