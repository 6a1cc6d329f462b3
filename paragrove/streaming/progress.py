"""Append-only logs as streams: keyed deduplication, progress counters, and windows over events.

All run with an available-now trigger or continuously; state is keyed, and a checkpoint folder makes a run resume where it
stopped. Windows and watermarks are extensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paragrove.runtime import Shelf


def log(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet files under a path or glob."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def dedup(stream: DataFrame, keys: list[str], event_time: str | None = None, late: str = "1 day") -> DataFrame:
    """The first record of every key; with an event time, keys older than the watermark are forgotten."""
    if event_time:
        return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def progress(stream: DataFrame, key: str) -> DataFrame:
    """key, n, ok, errors, kept up to date."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.sum((F.col("status") == "ok").cast("bigint")).alias("ok"), F.sum((F.col("status") == "error").cast("bigint")).alias("errors"))


def windows(stream: DataFrame, at: str, key: str, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """key, start, n, total of tumbling or sliding windows."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(key, F.col("w.start").alias("start"), "n", "total")


def sessions(stream: DataFrame, at: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """key, start, end, n of sessions that a gap ends."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is available into a Parquet table, and read it."""
    spark = stream.sparkSession
    shelf = Shelf(spark)
    q = stream.writeStream.format("parquet").option("path", f"{shelf.root}/{name}").option("checkpointLocation", f"{shelf.root}/{name}-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{shelf.root}/{name}")


def run_complete(stream: DataFrame, name: str) -> DataFrame:
    """Run an aggregate over what is available; each batch replaces the table, the last one is read."""
    spark = stream.sparkSession
    shelf = Shelf(spark)
    last: list[int] = []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{shelf.root}/{name}-{batch}")
        last.append(batch)

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{shelf.root}/{name}-state").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{shelf.root}/{name}-{last[-1]}") if last else spark.createDataFrame([], stream.schema)
