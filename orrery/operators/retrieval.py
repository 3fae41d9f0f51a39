"""Hybrid retrieval: full text, vectors, symbol names and graph, fused by reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import cosine, document_terms, similarity
from orrery.session import written

RRF_K = 60
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def postings(chunks: DataFrame) -> DataFrame:
    """term, chunk_id, tf. chunks: chunk_id, content."""
    return chunks.select("chunk_id", F.explode(document_terms(F.col("content"))).alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def posting_counts(chunks: DataFrame) -> DataFrame:
    """chunk_id, terms, tokens: how many postings a chunk has in :func:`postings`, and the sum of their tf. A row of chunks is
    counted where it is; only ids of several rows are looked at again, word by word."""
    ts = F.col("ts")
    own = chunks.select("chunk_id", document_terms(F.col("content")).alias("ts")).select("chunk_id", F.size(F.array_distinct(ts)).alias("terms"), F.size(ts).alias("tokens"))
    per = own.groupBy("chunk_id").agg(F.count("*").alias("rows"), F.max("terms").cast("long").alias("terms"), F.sum("tokens").alias("tokens"))
    per = written(per.where("tokens > 0"), "counts")  # not before: the filter would read the text once more
    once, again = per.where("rows = 1").select("chunk_id", "terms", "tokens"), per.where("rows > 1").select("chunk_id")
    if again.isEmpty():
        return once
    more = postings(chunks.join(again, "chunk_id", "left_semi")).groupBy("chunk_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"))
    return once.unionByName(more)


def lengths(chunks: DataFrame) -> DataFrame:
    """chunk_id, dl; a map, without a shuffle."""
    return chunks.select("chunk_id", F.size(document_terms(F.col("content"))).alias("dl"))


def bm25(chunks: DataFrame, terms: list[str], limit: int | None = 10) -> DataFrame:
    """chunk_id, score of the chunks with any of the terms, best first. Only the terms' own rows are shuffled: a chunk's
    counts of the terms come from one pass over its text, and are stored, as the statistics and the hits both need them."""
    own = chunks.select("chunk_id", document_terms(F.col("content")).alias("ts"))
    tf = [(F.size("ts") - F.size(F.array_remove("ts", t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    own = written(own.select("chunk_id", F.size("ts").alias("dl"), *tf), "counts")
    stats = own.agg(
        F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))
    )
    hit = own.where(" OR ".join(f"tf{i} > 0" for i in range(len(terms))) or "false").crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(LEAST_IDF))
        norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
        score = score + idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + norm)
    out = hit.select("chunk_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "chunk_id")
    return out if limit is None else out.limit(limit)


def nearest(vectors: DataFrame, query: Column, limit: int = 20, least: float | None = None) -> DataFrame:
    """chunk_id, sim of the ``limit`` nearest by cosine distance (ties by chunk_id), those under ``least`` dropped afterwards.
    query is a literal. A sim is 0 to 1: of a distance of 1 or more it is 0."""
    near = F.round(1 - cosine(F.col("vector"), query), 6)
    out = vectors.select("chunk_id", near.alias("distance")).where(F.col("distance").isNotNull() & ~F.isnan("distance"))
    out = out.orderBy("distance", "chunk_id").limit(limit).select("chunk_id", F.round(similarity(F.col("distance")), 6).alias("sim"))
    return out if least is None else out.where(F.col("sim") >= least)


def symbol_hits(symbols: DataFrame, chunks: DataFrame, names: list[str]) -> DataFrame:
    """chunk_id of the chunks of symbols with exactly one of the names. The names are those of a question."""
    hit = symbols.where(F.col("name").isin(names)).select(F.col("id").alias("symbol_id"))
    return chunks.join(hit, "symbol_id", "left_semi").select("chunk_id")


def expand(edges: DataFrame, imports: DataFrame, seeds: DataFrame, file_of: DataFrame, hops: int = 2) -> DataFrame:
    """file_id, priority: files of callers and callees of the seeds (0: exact, 1: heuristic), the seeds' own files (2), then
    those imported up to ``hops`` away (3 and on), the least priority of each. Seeds aren't their own callers. seeds: node;
    file_of: node, file_id; imports: src_file, dst_file."""
    near = []
    for k, kind in enumerate(("exact", "heuristic")):
        some = edges.where(F.col("resolution") == kind)
        both = some.select(F.col("src").alias("node"), F.col("dst").alias("o")).unionByName(some.select(F.col("dst").alias("node"), F.col("src").alias("o")))
        near.append(both.join(seeds, "node", "left_semi").select(F.col("o").alias("node")).join(seeds, "node", "left_anti").join(file_of, "node").select("file_id", F.lit(k).alias("priority")))
    out = near[0].unionByName(near[1])
    frontier = file_of.join(seeds, "node", "left_semi").select("file_id").distinct()
    out = out.unionByName(frontier.withColumn("priority", F.lit(2)))
    for h in range(max(1, hops)):
        frontier = imports.join(frontier.withColumnRenamed("file_id", "src_file"), "src_file", "left_semi").select(F.col("dst_file").alias("file_id")).distinct()
        out = out.unionByName(frontier.withColumn("priority", F.lit(3 + h)))
    return out.groupBy("file_id").agg(F.min("priority").alias("priority"))


def graph_chunks(edges: DataFrame, imports: DataFrame, seeds: DataFrame, file_of: DataFrame, chunks: DataFrame, hops: int = 2) -> DataFrame:
    """chunk_id, priority: all chunks of the seeds' callers and callees (0: exact, 1: heuristic), of the seeds' own files
    (2), then of the files imported up to ``hops`` away (3 and on), the least priority of each. seeds: node; file_of:
    node, file_id; imports: src_file, dst_file; chunks: chunk_id, symbol_id, file_id."""
    out = None
    for k, kind in enumerate(("exact", "heuristic")):
        some = edges.where(F.col("resolution") == kind)
        both = some.select(F.col("src").alias("node"), F.col("dst").alias("o")).unionByName(some.select(F.col("dst").alias("node"), F.col("src").alias("o")))
        near = both.join(seeds, "node", "left_semi").select(F.col("o").alias("node")).join(seeds, "node", "left_anti").withColumnRenamed("node", "symbol_id")
        near = chunks.join(near, "symbol_id", "left_semi").select("chunk_id", F.lit(k).alias("priority"))
        out = near if out is None else out.unionByName(near)
    frontier = file_of.join(seeds, "node", "left_semi").select("file_id").distinct()
    for h in range(max(1, hops) + 1):
        out = out.unionByName(chunks.join(frontier, "file_id", "left_semi").select("chunk_id", F.lit(2 + h).alias("priority")))
        frontier = imports.join(frontier.withColumnRenamed("file_id", "src_file"), "src_file", "left_semi").select(F.col("dst_file").alias("file_id")).distinct()
    return out.groupBy("chunk_id").agg(F.min("priority").alias("priority"))


def ranked_all(hits: DataFrame, source: str, *order: str, offset: int = 0) -> DataFrame:
    """As ``ranked``, of a list of any length: ranked in ranges, which only their counts join. order: columns, ascending."""
    parts = written(hits.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    before = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    out = parts.withColumn("k", rank).join(F.broadcast(before), "part")  # a row for each range
    return out.select("chunk_id", (F.col("k") + F.col("before")).alias("rank"), F.lit(source).alias("source"), F.lit(offset).alias("off"))


def ranked(hits: DataFrame, source: str, *order: Column, offset: int = 0) -> DataFrame:
    """chunk_id, rank (from 0), source, off. hits are a limited list, so one partition orders them."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1).select("chunk_id", "rank", F.lit(source).alias("source"), F.lit(offset).alias("off"))


def fuse(*lists: DataFrame) -> DataFrame:
    """chunk_id, score, sources, first: the sum of 1 / (RRF_K + rank + offset) over all lists, and the first of the lists
    that has the chunk with its rank there (what breaks ties)."""
    every = None
    for k, x in enumerate(lists):
        x = x.withColumn("list", F.lit(k))
        every = x if every is None else every.unionByName(x)
    score = F.sum(1.0 / (RRF_K + F.col("rank") + F.col("off")))
    sources = F.array_join(F.array_sort(F.collect_set("source")), ",")
    return every.groupBy("chunk_id").agg(F.round(score, 9).alias("score"), sources.alias("sources"), F.min(F.struct("list", "rank")).alias("first"))


def best(fused: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best of ``fuse``: by score, ties by the first list that has a chunk and its rank there."""
    return fused.orderBy(F.desc("score"), "first").limit(limit).drop("first")


def rerank_pool(n: Column) -> Column:
    """max(10, min(50, n div 10))."""
    return F.greatest(F.lit(10), F.least(F.lit(50), F.floor(n / 10)))


def within_budget(ranked_chunks: DataFrame, budget: int) -> DataFrame:
    """The chunks, best first, as long as their tokens fit. ranked_chunks: rank, tokens; a limited list."""
    running = F.sum("tokens").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked_chunks.withColumn("used", running).where(F.col("used") <= budget)


def context(chunks: DataFrame, budget: int, top: int = 8) -> str:
    """The text of the ``top`` chunks (rank, path, title, line_start, line_end, content): by file in order of its best
    chunk, in a file by line; each chunk only if it still fits the budget of tokens."""
    rows = chunks.orderBy("rank").limit(top).collect()
    files: dict = {}
    for r in rows:
        files.setdefault(r["path"] or f"wiki:{r['title']}", []).append(r)
    out, left = [], budget
    for path, own in files.items():
        head, body = f"## {path}", []
        for r in sorted(own, key=lambda r: r["line_start"] or 0):
            text = f"[lines {r['line_start']}-{r['line_end']}]\n{r['content']}"
            cost = max(1, len(text) // 3)
            if cost <= left:
                body.append(text)
                left -= cost
        if body:
            out.append("\n".join([head, *body]))
    return "\n\n".join(out)
