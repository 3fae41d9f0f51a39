"""``python -m orrery.cli index|status|definition|callers|callees|impact|search``; all but index print JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery import store
from orrery.functions.text import identifiers, query_terms
from orrery.operators import graph, retrieval
from orrery.session import DEFAULTS


def symbols_of(spark: SparkSession, out: str) -> DataFrame:
    return store.read(spark, out, "symbols").withColumn("file_id", F.col("file"))


def run(spark: SparkSession, args: argparse.Namespace) -> list[dict]:
    if args.command == "index":
        return [store.index(spark, args.root, args.store, args.exclude)]
    if args.command == "status":
        return [{"table": t, "rows": store.read(spark, args.store, t).count()} for t in store.TABLES]
    if args.command == "search":
        return search(spark, args.store, args.text, args.top)
    symbols = symbols_of(spark, args.store)
    hits = graph.find_symbols(symbols, args.text)
    if args.command == "definition":
        return [r.asDict() for r in hits.select("qname", "kind", "file", "line_start", "line_end", "signature").collect()]
    first = hits.first()
    if first is None:
        return []
    edges = store.read(spark, args.store, "calls")
    if args.command == "impact":
        out = graph.impact(edges, spark.createDataFrame([(first["id"],)], "node long"), args.depth)
        out = out.join(symbols.select(F.col("id").alias("node"), "qname", "file"), "node").orderBy("depth", "qname").drop("node")
    else:
        files = symbols.select("file_id", F.col("file").alias("path")).distinct()
        out = getattr(graph, args.command)(edges, symbols, files, first["id"]).drop("src", "dst")
    return [r.asDict() for r in out.collect()]


def search(spark: SparkSession, out: str, text: str, top: int) -> list[dict]:
    """Full text and exact names, fused."""
    question = spark.range(1).select(query_terms(F.lit(text)).alias("terms"), identifiers(F.lit(text)).alias("names")).first()
    chunks = store.read(spark, out, "chunks")
    lists = []
    if question["terms"]:
        lists.append(retrieval.ranked(retrieval.bm25(chunks, question["terms"]), "fts", F.desc("score"), F.col("chunk_id")))
    named = store.read(spark, out, "symbols").where(F.col("name").isin([*question["names"], *(t for t in question["terms"] if len(t) > 2)]))
    own = chunks.join(named.select(F.col("file"), F.col("qname").alias("title")), ["file", "title"], "left_semi").select("chunk_id")
    lists.append(retrieval.ranked_all(own, "symbol", "chunk_id"))
    best = retrieval.fuse(*lists).orderBy(F.desc("score"), "first").limit(top)
    rows = best.join(chunks.select("chunk_id", "file", "title", "line_start", "line_end"), "chunk_id").orderBy(F.desc("score"), "first")
    return [r.asDict() for r in rows.drop("first").collect()]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="orrery")
    p.add_argument("--store", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("index")
    one.add_argument("root")
    one.add_argument("--exclude", action="append")
    sub.add_parser("status")
    for name in ("definition", "callers", "callees", "impact", "search"):
        one = sub.add_parser(name)
        one.add_argument("text")
        one.add_argument("--depth", type=int, default=10)
        one.add_argument("--top", type=int, default=20)
    args = p.parse_args(argv)
    spark = SparkSession.builder.config(map=DEFAULTS).getOrCreate()
    out = run(spark, args)
    for row in out:
        print(json.dumps(row, ensure_ascii=False))
    return 0 if out else 1


if __name__ == "__main__":
    sys.exit(main())
