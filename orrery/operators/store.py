"""Changes to tables: upserts, cascading deletes, differences, orphans, caches. Writers replace whole tables or partitions, so
a run that is repeated leaves the same state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace those of equal key."""
    return existing.join(new, key, "left_anti").unionByName(new)


def cascade_delete(gone: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the files in ``gone`` (file_id). A table 'edges' (src_file, dst_file) loses both ends'."""
    out = {}
    for name, df in tables.items():
        keys = ["src_file", "dst_file"] if name == "edges" else ["file_id"]
        for k in keys:
            df = df.join(gone.select(F.col("file_id").alias(k)), k, "left_anti")
        out[name] = df
    return out


def scan_changes(scanned: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """rel, status: A new, M changed (time and hash differ, or force), D gone. Both: rel, hash, mtime."""
    s, k = scanned.alias("s"), known.alias("k")
    status = (
        F.when(F.col("k.rel").isNull(), "A")
        .when(F.col("s.rel").isNull(), "D")
        .when(F.lit(force) | ((F.col("s.mtime") != F.col("k.mtime")) & (F.col("s.hash") != F.col("k.hash"))), "M")
    )
    both = s.join(k, F.col("s.rel") == F.col("k.rel"), "full_outer")
    return both.select(F.coalesce("s.rel", "k.rel").alias("rel"), status.alias("status")).where(F.col("status").isNotNull())


def name_status(lines: DataFrame) -> DataFrame:
    """rel, status of ``git diff --name-status`` lines (column line): a rename is D of the old and A of the new path, a copy
    A of the new one, A and D stay, anything else is M."""
    cells = F.split("line", "\t")
    kind, a, b = F.substring(cells[0], 1, 1), F.get(cells, F.lit(1)), F.get(cells, F.lit(2))
    row = lambda rel, status: F.struct(rel.alias("rel"), status.alias("status"))
    rows = (
        F.when(kind == "R", F.array(row(a, F.lit("D")), row(b, F.lit("A"))))
        .when(kind == "C", F.array(row(b, F.lit("A"))))
        .otherwise(F.array(row(a, F.when(kind.isin("A", "D"), kind).otherwise("M"))))
    )
    return lines.where(F.length("line") > 0).select(F.explode(rows).alias("r")).select("r.rel", "r.status")


def orphans(vectors: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    return vectors.join(valid.select(key), key, "left_anti")


def unembedded_files(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """file_id of the files with a chunk that has no vector."""
    return chunks.join(vectors, "chunk_id", "left_anti").select("file_id").distinct()


def cache_lookup(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """chunks with ``hit``: whether the cache has their hash and model. Cache keys are unique."""
    return chunks.join(cache.withColumn("hit", F.lit(True)), ["content_hash", "model"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def first_of_file(chunks: DataFrame) -> DataFrame:
    """The first chunk of each (file, kind, symbol, hash)."""
    w = Window.partitionBy("file_id", "kind", F.coalesce("symbol_id", F.lit(0)), "content_hash").orderBy("ord")
    return chunks.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def access_frequency(accesses: DataFrame) -> DataFrame:
    """Equal rows counted as freq."""
    return accesses.groupBy(*accesses.columns).agg(F.count("*").alias("freq"))


def merge_frequency(a: DataFrame, b: DataFrame) -> DataFrame:
    """The larger freq of equal accesses."""
    keys = [c for c in a.columns if c != "freq"]
    return a.unionByName(b).groupBy(*keys).agg(F.max("freq").alias("freq"))


def apply_profile(tables: DataFrame, profile: DataFrame) -> DataFrame:
    """Statistics of ``profile`` (name, row_count, data_length) replace those of the tables it names, also by null."""
    named = profile.withColumn("given", F.lit(True)).withColumnsRenamed({"row_count": "r", "data_length": "d"})
    out = tables.join(named, "name", "left")
    pick = lambda new, old: F.when(F.col("given"), F.col(new)).otherwise(F.col(old)).alias(old)
    return out.select("name", pick("r", "row_count"), pick("d", "data_length"))
