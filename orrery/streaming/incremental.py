"""Incremental indexing as a stream: new and changed files are parsed and upserted, batch by batch. Files that go are found by
the batch difference (:func:`orrery.operators.store.scan_changes`), as a file stream cannot see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources import ingest


def follow(spark: SparkSession, root: str, out: str, checkpoint: str, language_filter: str | None = None):
    """A query that writes each batch's symbols to ``out``, a folder for each batch; start it with ``.start()``. A batch that runs
    again after a failure overwrites its own folder, so nothing is counted twice."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    files = files.select(F.regexp_replace("path", "^.*?" + root.split("://")[-1].strip("/") + "/", "").alias("rel"), "content", F.col("modificationTime").alias("at"))

    def write(batch: DataFrame, number: int) -> None:
        some = ingest.readable(batch)
        some = some if language_filter is None else some.where(F.col("language") == language_filter)
        ingest.symbol_rows(ingest.parsed(some)).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The latest symbols of each file."""
    rows = spark.read.parquet(out)
    latest = rows.groupBy("file").agg(F.max("batch").alias("batch"))
    return rows.join(latest, ["file", "batch"], "left_semi")


def usage_by_window(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """A stream of usage rows (ts, stage, cost) summed by window and stage; rows later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "stage").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"))
