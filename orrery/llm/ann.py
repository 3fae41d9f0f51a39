"""Approximate nearest neighbours: an inverted file with product-quantised residuals and exact reranking.

A bounded sample (SAMPLE vectors) trains coarse centroids, whose number grows with the root of the table's size up to
MOST_LISTS, and, on residuals, the sub-quantisers' codebooks. On the sample it is measured how many lists a query has to
probe for COVERED of its neighbours; so vectors with clusters need few probes and vectors without any need most. Every
vector is indexed once: a table holds its list and its code beside it. In each task, asymmetric tables (query against
codebooks) score the codes of the probed lists, in blocks, and the best RERANK different vectors of each query and block,
and all that tie with the last of them, are scored exactly in double precision on the original vectors. Equal vectors of a
block are one candidate, from which the smallest ids are taken. Vectors are never shuffled; only the best K of each query
and task are, and are merged.

The queries are a stated set. They go to the workers QUERY_BLOCK at a time; each block is one pass over the index, whose
result is written before the next block is read, so that what is broadcast and what the driver holds is bounded.

Hot lists (a third of all vectors may be equal) are spread over tasks as the input is. Ties are broken by id.

Defined cases: vectors that are null, of zero norm or not finite in some component, or that have another dimension than
most sampled ones, take no part, nor do null ids; a repeated id is a candidate for each of its rows, and as a query it
has the least of its vectors; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import shared_dir, written

K = 20
SAMPLE = 20_000
LEAST_LISTS, MOST_LISTS, COVERED = 16, 4096, 0.97
PARTS, CODES = 16, 64
RERANK = 500
QUERY_BLOCK = 4096
BLOCK = 4096


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of least squared distance of each row."""
    return ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=k)
        for j in range(x.shape[1]):
            centres[:, j] = np.where(n > 0, np.bincount(own, x[:, j], k) / np.maximum(n, 1), centres[:, j])
    return centres


class Index:
    def __init__(self, sample: np.ndarray, lists: int, parts: int = PARTS, codes: int = CODES):
        self.dim = sample.shape[1]
        while self.dim % parts:
            parts //= 2
        self.parts, self.width = parts, self.dim // parts
        self.coarse = k_means(sample, lists)
        residual = sample - self.coarse[nearest(sample, self.coarse)]
        self.books = [k_means(residual[:, p * self.width : (p + 1) * self.width], codes) for p in range(parts)]

    def probes(self, sample: np.ndarray, k: int) -> int:
        """The lists that a query probes so that COVERED of its k nearest are in them, as measured on the sample."""
        own, ranks = nearest(sample, self.coarse), []
        for q in range(0, len(sample), max(1, len(sample) // 64)):
            s = sample @ sample[q]
            s[q] = -np.inf
            order = np.empty(len(self.coarse), np.int64)
            order[np.argsort(-(self.coarse @ sample[q]), kind="stable")] = np.arange(len(self.coarse))
            ranks.append(order[own[np.argsort(-s)[: min(k, len(sample) - 1)]]])
        found = np.concatenate(ranks)
        return int(np.quantile(found, COVERED)) + 1 if len(found) else len(self.coarse)

    def add(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of each row."""
        own = nearest(x, self.coarse)
        r = x - self.coarse[own]
        w = self.width
        return own, np.stack([nearest(r[:, p * w : (p + 1) * w], b) for p, b in enumerate(self.books)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of the queries' parts with the codebooks: [query, part, code]."""
        w = self.width
        out = np.zeros((len(q), self.parts, max(map(len, self.books))), np.float32)
        for p, b in enumerate(self.books):
            out[:, p, : len(b)] = q[:, p * w : (p + 1) * w] @ b.T
        return out


def usable(v: str):
    """Not null, no null or non-finite component, not zero."""
    finite = f"forall({v}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < CAST('Infinity' AS DOUBLE))"
    return F.expr(f"{v} IS NOT NULL AND {finite} AND exists({v}, x -> x <> 0)")


def groups(x: np.ndarray) -> np.ndarray:
    """A number for each row, the same for rows of equal bytes."""
    x = np.ascontiguousarray(x)
    return np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1])))[:, 0], return_inverse=True)[1].reshape(-1)


def searcher(index: Index, ids: np.ndarray, queries: np.ndarray, probes: int, rerank: int, k: int):
    """The best k of a task's vectors for each query, by exact inner product among the best ``rerank`` approximate
    ones, which are different vectors, and their ties."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, index.dim)
            codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, index.parts)
            held.append((np.asarray(batch.column(0), np.int64), x, np.asarray(batch.column(2), np.int64), codes))
            n += batch.num_rows
            if n >= BLOCK * 4:
                yield from search(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if held:
            yield from search(*map(np.concatenate, zip(*held, strict=True)))

    def search(own_ids, x, lists, codes):
        group = groups(x)
        order = np.lexsort((own_ids, group, lists))
        own_ids, x, lists, codes, group = own_ids[order], x[order], lists[order], codes[order].astype(np.int64), group[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        end, group = np.r_[first[1:], len(group)], np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(group)]))
        x, lists, codes = x[first], lists[first], codes[first]
        by_id = np.argsort(own_ids, kind="stable")
        sorted_ids = own_ids[by_id]
        starts = np.searchsorted(lists, np.arange(len(index.coarse) + 1))
        tables = index.tables(queries)
        coarse = queries @ index.coarse.T
        probe = np.argsort(-coarse, 1, kind="stable")
        held = np.bincount(lists, end - first, len(index.coarse))
        out_q, out_i, out_s = [], [], []
        part = np.arange(index.parts)
        for n, q in enumerate(queries):
            # more lists than measured where those of this block hold too few
            several = np.searchsorted(np.cumsum(held[probe[n]]), k + np.searchsorted(sorted_ids, ids[n], "right") - np.searchsorted(sorted_ids, ids[n])) + 1
            spans = [np.arange(starts[c], starts[c + 1]) for c in probe[n][: max(probes, several)] if starts[c] < starts[c + 1]]
            if not spans:
                continue
            at = np.concatenate(spans)
            own = group[by_id[np.searchsorted(sorted_ids, ids[n]) : np.searchsorted(sorted_ids, ids[n], "right")]]
            most = k
            if len(own):
                most += len(own)
                own, rows = np.unique(own, return_counts=True)
                at = at[~np.isin(at, own[rows == end[own] - first[own]])]
            if len(at) > rerank:
                near = tables[n][part, codes[at]].sum(1) + coarse[n][lists[at]]
                at = at[near >= np.partition(near, -rerank)[-rerank]]
            # Not a matrix product: its rounding depends on a row's place, and copies in other tasks must tie.
            s = (x[at] * q).sum(1)
            if len(at) > k:
                best = s >= np.partition(s, -k)[-k]
                at, s = at[best], s[best]
            rows = [np.arange(first[g], min(end[g], first[g] + most)) for g in at]
            s = np.repeat(s, [len(r) for r in rows])
            rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            others = own_ids[rows] != ids[n]
            rows, s = own_ids[rows[others]], s[others]
            best = np.lexsort((rows, -s))[:k]
            out_q += [ids[n]] * len(best)
            out_i.append(rows[best])
            out_s.append(s[best])
        if out_q:
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_q, pa.int64()), pa.array(np.concatenate(out_i)), pa.array(np.concatenate(out_s))],
                names=["query_id", "vec_id", "score"],
            )

    return run


def build(rows: DataFrame, k: int) -> tuple[Index, int] | None:
    """An index without vectors and the lists to probe. rows: id, v (usable, of one dimension)."""
    n = rows.count()
    share = min(1.0, SAMPLE / max(1, n))
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(2 * SAMPLE)
    got = picked.select("v").toArrow()["v"].combine_chunks()
    if not len(got):
        return None
    sample = np.asarray(got.flatten(), np.float64).reshape(len(got), -1)
    index = Index(sample, min(MOST_LISTS, max(LEAST_LISTS, int(n**0.5 / 2))))
    return index, index.probes(sample, k)


def indexer(index: Index):
    """id, v, list and code of each vector."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, index.dim)
                lists, codes = index.add(x)
                cols = [pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["id", "v", "list", "codes"])

    return run


def search(vecs: DataFrame, queries, k: int = K, key: str = "vec_id", vector: str = "embedding", probes: int | None = None, rerank: int = RERANK) -> DataFrame:
    """Each query's ``k`` nearest: query_id, rank, the key and score. queries: a condition on the column ``id``; probes: as
    measured, if not given."""
    spark = vecs.sparkSession
    rows = vecs.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & usable("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = f"query_id long, {key} long, score double"
    out = spark.createDataFrame([], schema)
    if sizes:
        rows = rows.where(F.size("v") == sizes[0]["d"])
        index, measured = build(rows, k)
        stored = written(rows.mapInArrow(indexer(index), "id long, v array<double>, list int, codes binary"), "index")
        path = f"{shared_dir(spark)}/nearest-{uuid.uuid4().hex}"
        spark.createDataFrame([], schema).write.parquet(path)
        asked = stored.where(queries).groupBy("id").agg(F.min("v").alias("v"))
        block = []

        def one_pass() -> None:
            ids = np.array([r["id"] for r in block], np.int64)
            q = np.array([r["v"] for r in block], np.float64)
            work = searcher(index, ids, q, min(probes or measured, len(index.coarse)), rerank, k)
            stored.mapInArrow(work, schema).write.mode("append").parquet(path)
            block.clear()

        for r in asked.toLocalIterator(prefetchPartitions=True):
            block.append(r)
            if len(block) == QUERY_BLOCK:
                one_pass()
        if block:
            one_pass()
        out = spark.read.schema(schema).parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", key, "score")


def op8_nearest(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


QUERIES = {"op8_nearest": op8_nearest}
ORACLE_SQL: dict[str, str] = {}
