"""Embeddings: an offline embedder, a cache, a vector table with upserts, and an inverted index of it.

A vector row is: chunk_id, content_hash, model, vector. ``embed`` takes any function from texts to vectors; ``hashed`` is the
one that needs no endpoint. Tables are replaced by what these functions return, so a run that is repeated leaves the same."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import document_terms
from orrery.operators.retrieval import nearest
from orrery.operators.store import upsert
from orrery.session import written

BATCH = 20
#: An index is made from so many rows on; below, the exact search reads them all.
LEAST_ROWS = 2048
PREFIX = {"document": "", "query": "query: "}


def hashed(content: Column, dim: int = 64) -> Column:
    """A unit vector of term counts: each term adds 1 or -1 to a place, both by its hash. Null of a text without terms."""
    at = lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int")
    sign = lambda t: F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    terms = document_terms(content)
    places = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(terms, lambda t: at(t) == i), F.lit(0.0), lambda s, t: s + sign(t)))
    norm = F.sqrt(F.aggregate(places, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(places, lambda x: x / norm))


def embed(chunks: DataFrame, cache: DataFrame, model: str, vectors_of: Callable[[list[str]], list[list[float]]], dim: int, prefix: str = PREFIX["document"]) -> DataFrame:
    """content_hash, model, vector of what the cache lacks, each different content once. chunks: content_hash, content;
    cache: content_hash, model. ``vectors_of`` gets BATCH texts at a time, with the prefix; a vector of another dimension,
    or fewer vectors than texts, is an error."""
    missing = chunks.join(cache.where(F.col("model") == model), "content_hash", "left_anti")
    missing = missing.groupBy("content_hash").agg(F.min("content").alias("content"))

    def run(batches: Iterator):
        import pandas as pd

        for frame in batches:
            out = []
            for a in range(0, len(frame), BATCH):
                texts = [prefix + t for t in frame["content"][a : a + BATCH]]
                got = vectors_of(texts)
                if len(got) != len(texts) or any(len(v) != dim for v in got):
                    raise ValueError(f"the embedder gave {len(got)} vectors for {len(texts)} texts, or not {dim} numbers each")
                out += [[float(x) for x in v] for v in got]
            yield pd.DataFrame({"content_hash": frame["content_hash"], "model": model, "vector": out})

    return missing.mapInPandas(run, "content_hash string, model string, vector array<double>")


def cached(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with the new vectors; those of equal hash and model are replaced."""
    return upsert(cache, new, ["content_hash", "model"])


def add(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """The vector table with the new rows, each chunk once."""
    return upsert(vectors, new, ["chunk_id"])


def without_files(vectors: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """The vector table without the chunks of ``files`` (file_id). chunks: chunk_id, file_id."""
    return vectors.join(chunks.join(files, "file_id", "left_semi").select("chunk_id"), "chunk_id", "left_anti")


def rebuilt(refs: DataFrame, chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """chunk_id, content_hash, model, vector of all references (chunk_id, model) to chunks that are there; the vector is
    null where the cache has none. cache: content_hash, model, vector."""
    return refs.join(chunks.select("chunk_id", "content_hash"), "chunk_id").join(cache, ["content_hash", "model"], "left").select("chunk_id", "content_hash", "model", "vector")


def rebuild_counts(table: DataFrame) -> DataFrame:
    """rebuilt, missing of ``rebuilt``'s rows."""
    return table.agg(F.count("vector").alias("rebuilt"), F.count_if(F.col("vector").isNull()).alias("missing"))


class Lists:
    """An inverted index of a vector table: rows with the number of their list, and the lists' centres (a bounded array)."""

    def __init__(self, rows: DataFrame, centres: np.ndarray):
        self.rows, self.centres = rows, centres

    def nearest(self, query: list[float], limit: int = 20, probes: int = 8) -> DataFrame:
        """As ``retrieval.nearest``, in the ``probes`` lists nearest to the query alone: a filter that prunes partitions."""
        q = np.asarray(query, float)
        order = np.argsort(-self.centres @ q, kind="stable")[:probes].tolist()
        return nearest(self.rows.where(F.col("list").isin(order)), F.array(*map(F.lit, map(float, query))), limit)


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / norm)


def indexed(vectors: DataFrame, lists: int = 32, sample: int = 20_000, rounds: int = 6) -> Lists | None:
    """An index if there are LEAST_ROWS or more; centres come from a bounded sample, every row is in a list."""
    n = vectors.count()
    if n < LEAST_ROWS:
        return None
    rows = vectors.select("chunk_id", F.col("vector").cast("array<double>").alias("vector")).where(F.exists("vector", lambda x: x != 0))
    share = F.pmod(F.xxhash64("chunk_id"), F.lit(1_000_000)) <= int(1_000_000 * min(1.0, sample / n))
    got = np.array([r["u"] for r in rows.where(share).select(unit(F.col("vector")).alias("u")).limit(2 * sample).toLocalIterator()])
    rng = np.random.default_rng(3)
    centres = got[rng.choice(len(got), min(lists, len(got)), replace=False)]
    for _ in range(rounds):
        own = (got @ centres.T).argmax(1)
        sums = np.stack([got[own == k].sum(0) if (own == k).any() else c for k, c in enumerate(centres)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)

    def assign(batches: Iterator):
        for frame in batches:
            x = np.stack(frame["vector"].to_numpy()) if len(frame) else np.zeros((0, centres.shape[1]))
            yield frame.assign(list=(x @ centres.T).argmax(1) if len(x) else [])

    out = rows.mapInPandas(assign, "chunk_id long, vector array<double>, list int")
    return Lists(written(out, "lists"), centres)


def with_ranks(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sim"), "chunk_id")) - 1)  # a limited list
