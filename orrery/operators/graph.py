"""Queries over the code graph. symbols: id, name, qname, kind, file_id; edges: src, dst, kind, resolution, line; files:
file_id, path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import tail_name
from orrery.session import written


def find_symbols(symbols: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    """The first tier that has a hit: qualified name, name, then (for patterns with a dot or hash) tail name or a part of
    the qualified name. Modules are left out."""
    p, q = F.lit(pattern), F.col("qname")
    tail = F.lit("." in pattern or "#" in pattern)
    tier = (
        F.when(q == p, 1)
        .when(F.col("name") == p, 2)
        .when(tail & ((F.col("name") == tail_name(p)) | q.contains(pattern)), 3)
    )
    hits = symbols.where(F.col("kind") != "module").withColumn("tier", tier).where(F.col("tier").isNotNull())
    best = hits.agg(F.min("tier").alias("tier"))
    return hits.join(F.broadcast(best), "tier", "left_semi").orderBy("qname", "id").limit(limit)  # one row is broadcast


def call_rows(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Call edges with names and paths of both ends."""
    end = lambda k: symbols.join(files, "file_id").select(F.col("id").alias(k), F.col("qname").alias(f"{k}_name"), F.col("path").alias(f"{k}_path"))
    return edges.join(end("src"), "src").join(end("dst"), "dst").select("src", "src_name", "src_path", "dst", "dst_name", "dst_path", "resolution", "line")


def callers(edges: DataFrame, symbols: DataFrame, files: DataFrame, symbol_id: int) -> DataFrame:
    return call_rows(edges.where(F.col("dst") == symbol_id), symbols, files).orderBy("line", "src", "dst")


def callees(edges: DataFrame, symbols: DataFrame, files: DataFrame, symbol_id: int) -> DataFrame:
    return call_rows(edges.where(F.col("src") == symbol_id), symbols, files).orderBy("line", "src", "dst")


def impact(edges: DataFrame, seeds: DataFrame, max_depth: int = 10) -> DataFrame:
    """node, depth of what calls the seeds (column node), directly or through others, at the least depth; without the
    seeds. One join a level; each level is a table in the shared folder."""
    calls = edges.select(F.col("dst").alias("node"), F.col("src").alias("next")).distinct()
    seen = written(seeds.select("node", F.lit(0).alias("depth")).distinct(), "impact")
    frontier = seen
    for depth in range(1, max_depth + 1):
        new = calls.join(frontier.select("node"), "node").select(F.col("next").alias("node")).distinct()
        frontier = written(new.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "impact")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where(F.col("depth") > 0).orderBy("depth", "node")


def resolution_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.coalesce("resolution", F.lit("unknown")).alias("resolution")).agg(F.count("*").alias("edges"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))


def dependents(edges: DataFrame, symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """Files (file_id) whose symbols point into changed files, without the changed ones."""
    own = lambda k: symbols.select(F.col("id").alias(k), F.col("file_id").alias(f"{k}_file"))
    hit = own("dst").join(changed.select(F.col("file_id").alias("dst_file")), "dst_file", "left_semi")
    out = edges.join(hit, "dst").join(own("src"), "src").select(F.col("src_file").alias("file_id")).distinct()
    return out.join(changed, "file_id", "left_anti")


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distinct other ends of the seeds' (column node) edges: the union of two equi-joins, not a join with OR."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"))
    into = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"))
    near = out.unionByName(into).join(seeds.select("node"), "node").select(F.col("other").alias("node")).distinct()
    return near.join(seeds, "node", "left_anti")


def module_graph(imports: DataFrame, modules: DataFrame, limit: int = 20) -> DataFrame:
    """The module pairs with most imports. imports: src_file, dst_file; modules: file_id, module."""
    own = lambda k: modules.select(F.col("file_id").alias(f"{k}_file"), F.col("module").alias(f"{k}_module"))
    pairs = imports.groupBy("src_file", "dst_file").agg(F.count("*").alias("n"))
    pairs = pairs.join(own("src"), "src_file").join(own("dst"), "dst_file").where("src_module <> dst_module")
    out = pairs.groupBy("src_module", "dst_module").agg(F.sum("n").alias("imports"))
    return out.orderBy(F.desc("imports"), "src_module", "dst_module").limit(limit)


def mermaid(pairs: DataFrame) -> str:
    """A report of a limited number of pairs: of :func:`module_graph`."""
    return "graph TD\n" + "".join(f'  {r["src_module"]} -->|"imports: {r["imports"]}"| {r["dst_module"]}\n' for r in pairs.collect())


def sample_edges(edges: DataFrame, n: int, seed: int = 0, resolution: str | None = None) -> DataFrame:
    """n edges by a seeded hash of their ends: the same rows wherever it runs."""
    some = edges if resolution is None else edges.where(F.col("resolution") == resolution)
    return some.orderBy(F.xxhash64("src", "dst", F.lit(seed)), "src", "dst").limit(n)


def clusters(files: DataFrame, depth: int = 1) -> DataFrame:
    """module, path, hash: the first ``depth`` parts of each path; of a shorter path all."""
    own = F.array_join(F.slice(F.split("path", "/"), 1, depth), "/")
    return files.select(own.alias("module"), "path", "hash")


def segment(files: DataFrame, most: int = 60, least: int = 5) -> DataFrame:
    """module, path: clusters by the first directory; those of over ``most`` files are split one level deeper, once; those
    of under ``least`` join the large module that shares most leading parts of the path, one at least (the first in order
    if several). Where no large one shares a part, the first small one in order takes in the others that share its first."""
    one = clusters(files, 1).join(clusters(files, 2).select("path", F.col("module").alias("deep")), "path")
    size = one.groupBy("module").agg(F.count("*").alias("n"))
    one = one.join(size, "module").select(F.when(F.col("n") > most, F.col("deep")).otherwise(F.col("module")).alias("module"), "path")
    size = one.groupBy("module").agg(F.count("*").alias("n"))
    big, little = size.where(F.col("n") >= least).select("module"), size.where(F.col("n") < least).select(F.col("module").alias("small"))
    # a prefix of each length is an equi-join; no pair of modules is listed but those that share one
    cut = lambda c: F.expr(f"transform(sequence(1, size(split({c}, '/'))), i -> array_join(slice(split({c}, '/'), 1, i), '/'))")
    near = little.withColumn("p", F.explode(cut("small"))).join(big.withColumn("p", F.explode(cut("module"))).groupBy("p").agg(F.min("module").alias("module")), "p")
    near = near.groupBy("small").agg(F.max_by("module", F.length("p")).alias("into"))
    orphans = little.join(near, "small", "left_anti").withColumn("p", F.split("small", "/")[0])
    taken = orphans.join(orphans.groupBy("p").agg(F.min("small").alias("into")), "p").select("small", "into")
    near = near.unionByName(taken)
    moved = one.join(near, one["module"] == near["small"], "left")
    return moved.select(F.coalesce("into", "module").alias("module"), "path")


def module_hash(clustered: DataFrame) -> DataFrame:
    """One hash of the sorted hashes of each module's files."""
    joined = F.concat_ws("\n", F.array_sort(F.collect_list("hash")))
    return clustered.groupBy("module").agg(F.count("*").alias("files"), F.md5(joined).alias("source_hash"))


def pick_unique(sites: DataFrame, candidates: DataFrame) -> DataFrame:
    """site_id, dst. sites: site_id, name, argc; candidates: id, name, sig_argc. One candidate is taken unless both counts
    are known and differ; of several, the only one with an equal count. A site meets its name's counts, not its candidates."""
    by_count = candidates.groupBy("name", F.col("sig_argc").alias("argc")).agg(F.count("*").alias("equal"), F.min("id").alias("match"))
    by_name = by_count.groupBy("name").agg(F.sum("equal").alias("n"), F.sum(F.when(F.col("argc").isNotNull(), F.col("equal"))).alias("known"), F.min("match").alias("only"))
    met = sites.select("site_id", "name", "argc").join(by_name, "name").join(by_count, ["name", "argc"], "left")
    unequal = F.when(F.col("argc").isNotNull(), F.coalesce("known", F.lit(0)) - F.coalesce("equal", F.lit(0)))
    per = met.groupBy("site_id").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum("equal"), F.lit(0)).alias("equal"), F.min("only").alias("only"), F.min("match").alias("match"), F.coalesce(F.sum(unequal), F.lit(0)).alias("unequal")
    )
    dst = F.when((F.col("n") == 1) & (F.col("unequal") == 0), F.col("only")).when((F.col("n") > 1) & (F.col("equal") == 1), F.col("match"))
    return per.select("site_id", dst.alias("dst")).where(F.col("dst").isNotNull())


def cascade(sites: DataFrame, steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """site_id, dst, reason. Each step is a table site_id, dst of the sites to which it applies; a null dst is a decided
    miss, which stops the steps after it."""
    out = sites.select("site_id")
    order = []
    for k, (name, hits) in enumerate(steps):
        one = hits.groupBy("site_id").agg(F.min(F.struct(F.coalesce("dst", F.lit(-1)).alias("dst"), F.lit(name).alias("reason"))).alias(f"s{k}"))
        out = out.join(one, "site_id", "left")
        order.append(f"s{k}")
    found = F.coalesce(*order)
    return out.select("site_id", F.nullif(found["dst"], F.lit(-1)).alias("dst"), found["reason"].alias("reason")).where(F.col("dst").isNotNull())


def unique_by_name(classes: DataFrame) -> DataFrame:
    """name, id of names with exactly one id."""
    return classes.groupBy("name").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n")).where("n = 1").select("name", "id")


def first_candidate(candidates: DataFrame, modules: DataFrame) -> DataFrame:
    """Of the candidate paths of each import (ref, priority, path), the module of least priority. modules: path, id."""
    met = candidates.join(modules, "path")
    return met.groupBy("ref").agg(F.min_by("id", "priority").alias("id"))


def ordinal_names(symbols: DataFrame) -> DataFrame:
    """Second and later namesakes of a file get @line. symbols: file_id, idx, qname, line_start."""
    k = F.row_number().over(Window.partitionBy("file_id", "qname").orderBy("idx"))
    return symbols.withColumn("qname", F.when(k > 1, F.concat_ws("@", "qname", F.col("line_start").cast("string"))).otherwise(F.col("qname")))
