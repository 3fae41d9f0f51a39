"""The stored full-text index: postings by ranges of term hashes, and lengths. A question reads its terms' ranges alone.

postings: part, term, chunk_id, tf. lengths: chunk_id, dl. Both are tables in a folder; an update replaces the parts of the
postings that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.text import document_terms
from orrery.operators import retrieval as R

PARTS = 64


def part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def build(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """postings and lengths of chunks (chunk_id, content)."""
    return R.postings(chunks).select(part(F.col("term")).alias("part"), "term", "chunk_id", "tf"), R.lengths(chunks)


def write(chunks: DataFrame, path: str) -> None:
    """The words are shuffled once, each to its part's task, and counted, sorted and written there."""
    words = chunks.select("chunk_id", F.explode(document_terms(F.col("content"))).alias("term")).withColumn("part", part(F.col("term")))
    posts = words.repartitionById(PARTS, F.col("part")).groupBy("part", "term", "chunk_id").agg(F.count("*").alias("tf"))
    lengths = R.lengths(chunks)
    posts.sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")


def replaced(index: tuple[DataFrame, DataFrame], gone: DataFrame, new: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The index without the chunks in ``gone`` (chunk_id: of a chunk, a file or a repository) and with those of ``new``."""
    posts, lengths = (x.join(gone.select("chunk_id"), "chunk_id", "left_anti") for x in index)
    if new is None:
        return posts.select("part", "term", "chunk_id", "tf"), lengths
    more = build(new)
    return posts.unionByName(more[0]), lengths.unionByName(more[1])


def bm25(index: tuple[DataFrame, DataFrame], terms: list[str], limit: int | None = 10, allowed: DataFrame | None = None) -> DataFrame:
    """As ``retrieval.bm25``, from the stored index; ``allowed`` (chunk_id) restricts the hits, not the statistics."""
    posts, lengths = index
    asked = posts.where(F.col("part").isin(parts_of(posts, terms)) & F.col("term").isin(terms))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = asked.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term of the question
    hit = asked if allowed is None else asked.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
    hit = hit.join(F.broadcast(df), "term").join(lengths, "chunk_id").crossJoin(F.broadcast(stats))  # one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(R.LEAST_IDF))
    norm = R.K1 * (1 - R.B + R.B * F.col("dl") / F.col("avgdl"))
    out = hit.groupBy("chunk_id").agg(F.round(F.sum(idf * F.col("tf") * (R.K1 + 1) / (F.col("tf") + norm)), 6).alias("score"))
    out = out.orderBy(F.desc("score"), "chunk_id")
    return out if limit is None else out.limit(limit)


def parts_of(df: DataFrame, terms: list[str]) -> list[int]:
    """The parts that hold the terms: constants, so that a scan is pruned to their folders."""
    if not terms:
        return []
    row = df.sparkSession.range(1).select(*(part(F.lit(t)).alias(f"p{i}") for i, t in enumerate(terms))).first()
    return sorted(set(row))
