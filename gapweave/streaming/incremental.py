"""Importing signals as they arrive: an extension to the batch import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gapweave.operators.catalog import PEAK_SECONDS, Catalogue
from gapweave.operators.signal import peaks

#: One row per frame of a decoded file.
FRAMES = "name string, frame int, value double, fps double, duration double"


def hash_results(frames: DataFrame, peak_seconds: float = PEAK_SECONDS) -> DataFrame:
    """Import results of decoded frames: (name, fps, duration, index, brightness), as ``Catalogue.store`` takes them."""
    files = frames.groupBy("name").agg(
        F.max("fps").alias("fps"),
        F.coalesce(F.max("duration"), F.count(F.lit(1)) / F.max("fps")).alias("duration"),
        F.transform(F.array_sort(F.collect_list(F.struct("frame", "value"))), lambda x: x["value"]).alias("brightness"),
    )
    found = peaks(frames, "name", "frame", "value", peak_seconds, F.col("fps"))
    index = found.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("frame", "hash"))).alias("index"))
    empty = F.array().cast("array<struct<frame:int,hash:double>>")
    return files.join(index, "name", "left").withColumn("index", F.coalesce("index", empty))


def import_stream(spark: SparkSession, folder: str, catalogue: Catalogue, checkpoint: str, peak_seconds: float = PEAK_SECONDS) -> StreamingQuery:
    """Import parquet files of decoded frames as they arrive in a folder, each batch in one commit.

    A batch that is replayed after a failure replaces its own files, so it counts once.
    """
    stream = spark.readStream.schema(FRAMES).parquet(folder)

    def store(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            catalogue.store(hash_results(batch, peak_seconds))

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per window and kind; a stream drops events later than ``late``. Works on tables as well."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    counted = rows.groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("window.start").alias("window_start"), kind, "events")
