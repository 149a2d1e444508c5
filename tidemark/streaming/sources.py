"""Tails of stream tables with Structured Streaming, and what runs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import streams


def tail(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """New files of a Parquet folder as a stream; backpressure by files in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def live_counts(events: DataFrame, by: str) -> DataFrame:
    """A live group-by: counts that change with every batch (output mode 'update' or 'complete')."""
    return events.groupBy(by).agg(F.count("*").alias("n"))


def windowed(events: DataFrame, ts: str, size: str, late: str, by: str) -> DataFrame:
    """Tumbling windows with a watermark, an extension: rows later than ``late`` are dropped once their window is out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count("*").alias("n"))


def drain(stream: DataFrame, checkpoint: str, sink: str, mode: str = "append") -> None:
    """Everything that is there now, in micro-batches, into a Parquet folder; state and progress are under ``checkpoint``."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(sink)
    q.awaitTermination()


def drain_update(stream: DataFrame, checkpoint: str, sink: str, keys: list[str]) -> None:
    """As drain, for streams that change rows: each batch's rows replace those of their keys in a table written anew."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        target = f"{sink}/v{number:020d}"
        older = sorted(_versions(spark, sink))
        rows = batch
        if older:
            before = spark.read.parquet(f"{sink}/{older[-1]}")
            rows = batch.unionByName(before.join(batch.select(*keys), keys, "left_anti"))
        rows.write.mode("overwrite").parquet(target)

    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def newest(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(f"{sink}/{sorted(_versions(spark, sink))[-1]}")


def _versions(spark: SparkSession, sink: str) -> list[str]:
    """Versions that are complete, by the file system that the sink is on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sink)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    return [p.getName() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


producers = streams.stateful_producers
