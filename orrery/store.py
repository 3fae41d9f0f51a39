"""The tables of an indexed repository: one Parquet folder each, under a version that becomes current once all are written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import resolve
from orrery.sources import ingest

TABLES = ("files", "symbols", "contains", "imports", "calls", "chunks")


def index(spark: SparkSession, root: str, out: str, exclude: list[str] | None = None) -> dict[str, int]:
    """Scan, parse, chunk and resolve ``root`` into ``out``; the counts of rows. The marker of the version is written last, so a
    run that breaks off leaves the version before it current."""
    version = f"{out.rstrip('/')}/{uuid.uuid4().hex}"
    files = ingest.readable(ingest.scan(spark, root, exclude))
    files.select("rel", "language", "size", "mtime", F.md5("content").alias("hash")).write.parquet(f"{version}/files")
    ingest.parsed(files).write.parquet(f"{version}/parses")
    parses = spark.read.parquet(f"{version}/parses")
    ingest.symbol_rows(parses).write.parquet(f"{version}/symbols")
    symbols = spark.read.parquet(f"{version}/symbols")
    ingest.contains_edges(symbols).write.parquet(f"{version}/contains")
    resolve.import_edges(parses, symbols).write.parquet(f"{version}/imports")
    imports = spark.read.parquet(f"{version}/imports")
    resolve.call_edges(parses, symbols, imports).write.parquet(f"{version}/calls")
    chunks = ingest.chunked(files).withColumn("chunk_id", F.xxhash64("file", "ord"))
    chunks.write.parquet(f"{version}/chunks")
    counts = {t: spark.read.parquet(f"{version}/{t}").count() for t in TABLES}
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{out.rstrip('/')}/current")
    return counts


def read(spark: SparkSession, out: str, name: str) -> DataFrame:
    version = spark.read.parquet(f"{out.rstrip('/')}/current").first()["version"]
    return spark.read.parquet(f"{version}/{name}")
