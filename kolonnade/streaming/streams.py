"""Ledgers and events as streams: windowed counts with late data, and deliveries merged into the message store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kolonnade.operators.delivery import MessageStore
from kolonnade.session import scratch


def follow(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder, or over one file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    one = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rpartition("/")
    return source.option("pathGlobFilter", name).parquet(folder) if one else source.parquet(path)


def windowed(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "2 days", watermark: bool = True) -> DataFrame:
    """(window_start, key, n, total) per tumbling window; rows later than the watermark are left out of a stream."""
    rows = events.withWatermark(time, late) if watermark else events
    return rows.groupBy(F.window(time, width).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("window_start"), "key", "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 days", watermark: bool = True) -> DataFrame:
    """(key, session_start, session_end, n): sessions closed by a pause."""
    rows = events.withWatermark(time, late) if watermark else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def finished(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and return what it wrote; state and output lie in the shared folder."""
    spark = stream.sparkSession
    out = scratch(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        # complete mode hands over the whole result each time; the last one stays
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{out}/rows")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def merge_stream(deliveries: DataFrame, store: MessageStore, state: str, key="key", seq="seq", good="good", home="home", payload=()):
    """Merge every micro-batch of (key, seq, good, home, payload...) into the store; a batch that comes again after a failure changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        store.merge(batch, F.col(key), F.col(seq), F.col(good), F.col(home), payload, feed=state, number=number)

    return deliveries.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(merge).start()
