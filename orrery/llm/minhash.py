"""Near-duplicate documents by MinHash, verified on full sets, and their connected components.

1. map: each text's set of shingles (64-bit hashes), MINIMA minima of universal hashes in bands, and a 128-bit hash of
   the set. Texts of equal sets are one class from here on; its smallest id represents it.
2. Bands are bucket keys. Two sets that reach the threshold share no bucket with a probability below one in a million.
   A ``Rule`` holds shingle size, threshold and matching bands: op6 takes 3 words and 0.85.
3. A bucket's centre is its member that meets most others over all buckets, as an original does among its copies. All
   members of a centre's buckets are compared with it: signatures first, then full sets. The links are joined by
   alternating large-star and small-star. The rows are dealt in parts of bounded size, each with the centre's set.
4. What remains are pairs of members of one centre that are in different components. A shingle that only one component
   of the centre has cannot be shared by such a pair, so the others bound what a member can share: members that by that
   bound, and by sizes, can reach the threshold with no member of another component are done. In near copies of one
   text that are just below the threshold with it, these are nearly all: what an edit added is nobody else's.
5. The rest are compared on full sets in parts of bounded size by matrix products, each pair of parts in one task. Only
   links come out, a spanning forest from each task; pairs are never rows. No link is lost, and nothing is capped.

Links, components and sets are tables in the shared folder. Joins on hot keys have an exchange of their own on both sides,
so that adaptive execution can split them; minima of groups are taken map-side first.

Defined cases: a null text, or one without words, has no shingle and is a component of its own; with fewer words than a
shingle the whole sequence is the one shingle; a null id stays null and is kept; rows of equal id are one node; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import WordHashes, dropped, given_back, mix, small, text_parts, written

MINIMA = 120


class Rule(NamedTuple):
    """What near copies are: 100 * intersection >= threshold * union of shingles of ``size`` words."""

    size: int
    threshold: int
    #: Minima in a band; MINIMA // band bands.
    band: int
    #: Share of equal minima below which a pair cannot reach the threshold (over six standard deviations).
    least_equal: float


OP6 = Rule(3, 85, 5, 0.65)
FIVE_WORDS = Rule(5, 80, 4, 0.58)
#: Rows and shingles of a part: bounds on a task's memory, not on results.
PART_ROWS, PART_SHINGLES = 1024, 500_000
#: Classes whose bucket keys a task makes, counts and sorts: the same kind of bound.
KEY_ROWS = 8192
#: Ids that are broadcast at most (8 bytes each); beyond, the join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Ratio of neighbouring size classes.
SIZE_STEP = 1.02
U = np.uint64
_rng = np.random.default_rng(20)
FACTORS = _rng.integers(1, 1 << 63, MINIMA, dtype=np.uint64) | U(1)
TERMS = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def shingles(text: str | None, hashes: WordHashes, size: int = OP6.size) -> np.ndarray:
    """Distinct hashes, sorted. A-Z count as a-z."""
    words = hashes.of(text.encode("utf-8", "surrogatepass").lower().split()) if text else np.zeros(0, U)
    n = min(size, len(words))
    if not n:
        return words
    out = np.full(len(words) - n + 1, n, U)
    for k in range(n):
        out = mix(out * U(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return np.unique(out)


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, 0xFFFFFFFF, U)
    for a in range(0, len(s), 4096):
        out = np.minimum(out, ((s[a : a + 4096, None] * FACTORS[None] + TERMS[None]) >> U(32)).min(0))
    return out.astype(np.uint32)


def bands(m: np.ndarray, band: int) -> np.ndarray:
    """The bucket keys of minima: a hash of each band and its number."""
    parts = m.reshape(-1, band).astype(U)
    out = np.arange(len(parts), dtype=U) + U(1)
    for k in range(band):
        out = mix(out * U(0x9E3779B97F4A7C15) + parts[:, k])
    return out


def signatures(rule: Rule):
    """doc, n (shingles), s1, s2 (a hash of the set) and bands."""

    def run(batches):
        hashes = WordHashes()
        for batch in (part for batch in batches for part in text_parts(batch, 1)):
            ns, sums, keys = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, hashes, rule.size)
                ns.append(len(s))
                sums.append((int(mix(s).sum(dtype=U)), int(mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U))))
                keys.append(bands(minima(s), rule.band).view(np.int64) if len(s) else None)
            both = np.array(sums, U).reshape(len(sums), 2).view(np.int64)
            cols = [pa.array(ns, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc", "n", "s1", "s2", "bands"])

    return given_back(run)


def sets(rule: Rule):
    """doc, s (a hash of the set), minima and shingles; rows that repeat in a part of a batch once."""

    def run(batches):
        hashes = WordHashes()
        for batch in (part for batch in batches for part in text_parts(batch, 1)):
            found = {}
            for doc, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                s = shingles(text, hashes, rule.size)
                if len(s):
                    found.setdefault((doc, int(mix(s).sum(dtype=U).view(np.int64))), s)
            cols = [
                pa.array([k[0] for k in found], pa.int64()),
                pa.array([k[1] for k in found], pa.int64()),
                pa.array([minima(s).tobytes() for s in found.values()], pa.binary()),
                pa.array([s.view(np.int64) for s in found.values()], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "s", "minima", "shingles"])

    return given_back(run)


def runs(batches, keys: int):
    """The rows of equal values in the first ``keys`` columns (neighbours, as the input is sorted), as tables."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([np.asarray(batch.column(k), np.int64) for k in range(keys)], 1)
        cut = [0, *(np.flatnonzero((cols[1:] != cols[:-1]).any(1)) + 1).tolist(), len(cols)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            key = tuple(cols[a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def column(t: pa.Table, k: int):
    return t.column(k).combine_chunks()


def lists(t: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, one after another, and the lists' lengths."""
    c = column(t, k)
    return np.asarray(c.flatten()).view(U), np.asarray(c.value_lengths(), np.int64)


def reach(common, total, threshold: int):
    """Whether sets of ``total`` elements together, ``common`` of them shared, reach the threshold."""
    return (100 + threshold) * common >= threshold * total


def with_centre(rule: Rule):
    """The links (x, y) of a centre and its members. centre, part, member (false: the centre itself), doc, minima, shingles."""

    def run(batches):
        for t in runs(batches, 2):
            member = np.asarray(column(t, 2).cast(pa.int8())).astype(bool)
            doc = np.asarray(column(t, 3), np.int64)
            low = np.frombuffer(b"".join(column(t, 4).to_pylist()), np.uint32).reshape(len(doc), MINIMA)
            values, n = lists(t, 5)
            ends = np.cumsum(n)
            if member.all() or not member.any():
                continue
            found = np.zeros(len(doc), bool)
            for c in np.flatnonzero(~member):
                own = values[ends[c] - n[c] : ends[c]]
                hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
                common = np.add.reduceat(hit, ends - n, dtype=np.int64)
                found |= member & ((low == low[c]).mean(1) >= rule.least_equal) & reach(common, n + n[c], rule.threshold)
            links = np.unique(doc[found])
            centre = np.full(len(links), column(t, 0)[0].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(links), pa.array(centre)], names=["x", "y"])

    return given_back(run)


def forest(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Of the links between x and y, as many as join the same components."""
    root: dict[int, int] = {}

    def find(a: int) -> int:
        while (b := root.setdefault(a, a)) != a:
            root[a] = a = root[b]
        return a

    out = []
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        p, q = find(a), find(b)
        if p != q:
            root[p] = q
            out.append((a, b))
    return out


def across(rule: Rule):
    """The links (x, y: roots) between components. centre, i, j, part, root, n (of the whole set), shingles (those that
    several components have)."""

    def run(batches):
        for t in runs(batches, 3):
            part, root, n = (np.asarray(column(t, k), np.int64) for k in (3, 4, 5))
            values, lengths = lists(t, 6)
            one, other = (np.flatnonzero(part == column(t, k)[0].as_py()) for k in (1, 2))
            if not len(one) or not len(other):
                continue
            order, at = np.unique(values, return_inverse=True)
            row = np.repeat(np.arange(len(n)), lengths)
            by = np.argsort(at, kind="stable")
            row, at = row[by], at[by]
            common = np.zeros((len(one), len(other)), np.float32)
            for a in range(0, len(order), 4096):
                lo, hi = np.searchsorted(at, [a, a + 4096])
                dense = np.zeros((len(n), min(4096, len(order) - a)), np.float32)
                dense[row[lo:hi], at[lo:hi] - a] = 1
                common += dense[one] @ dense[other].T
            linked = reach(common.astype(np.int64), n[one][:, None] + n[other][None], rule.threshold)
            x, y = np.nonzero(linked & (root[one][:, None] != root[other][None]))
            if len(x):
                pairs = np.unique(np.sort(np.stack([root[one][x], root[other][y]], 1), 1), axis=0)
                out = np.array(forest(pairs[:, 0], pairs[:, 1]), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["x", "y"])

    return given_back(run)


def marked(edges: DataFrame):
    """The number of edges and a sum of their hashes."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)"))).first()


def stars(edges: DataFrame) -> DataFrame:
    """node, root: each node's smallest reachable node. edges: x, y. Alternates large-star and small-star."""
    edges = written(edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct(), "edges")
    before, seen = None, marked(edges)
    while seen[0] and seen != before:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        near = large.join(least, "x")
        new = near.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        new = written(new.unionByName(near.select("x", F.col("m").alias("y"))).distinct(), "edges")
        dropped(edges)
        edges = new
        before, seen = seen, marked(edges)
    return edges.select(F.col("x").alias("node"), F.col("y").alias("root"))


def memberships(classes: DataFrame) -> DataFrame:
    """centre, rep: each centre with the other members of its buckets. classes: rep, bands."""
    classes = classes.repartition(max(1, -(-classes.count() // KEY_ROWS)), "rep")
    keys = classes.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("a"), F.max("rep").alias("b"))
    shared = written(shared.where("a <> b").select("key", "size"), "shared")
    members = written(keys.join(shared, "key"), "members")
    popular = members.groupBy("rep").agg(F.sum("size").alias("met"))
    best = members.join(popular, "rep").groupBy("key").agg(F.max(F.struct("met", (-F.col("rep")).alias("least"))).alias("c"))
    best = written(best.select("key", (-F.col("c")["least"]).alias("centre")), "centres")
    out = members.join(best, "key").where("rep <> centre").select("centre", "rep").distinct()
    out = written(out, "memberships")
    dropped(shared, members, best)
    return out


def parts(rows: DataFrame, keys: list[str], hashed: list[str]) -> DataFrame:
    """``rows`` (keys, shingles, ...) with ``of``, the number of parts of their group, and ``part``, the one of the row."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("m"), F.sum(F.size("shingles")).alias("w"))
    of = F.greatest(F.ceil(F.col("m") / PART_ROWS), F.ceil(F.col("w") / PART_SHINGLES))
    sizes = written(sizes.select(*keys, of.alias("of")), "sizes")
    return rows.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64(*hashed), F.col("of")))


def centre_links(members: DataFrame, of_docs: DataFrame, rule: Rule) -> DataFrame:
    """Step 3. members: centre, rep; of_docs: doc, s, minima, shingles."""
    rows = members.join(of_docs.withColumnRenamed("doc", "rep"), "rep")
    rows = parts(rows, ["centre"], ["rep"])
    centres = rows.select("centre", "part").distinct().join(of_docs.withColumnRenamed("doc", "centre"), "centre")
    sides = rows.select("centre", "part", F.lit(True).alias("member"), F.col("rep").alias("doc"), "minima", "shingles")
    sides = sides.unionByName(centres.select("centre", "part", F.lit(False).alias("member"), F.col("centre").alias("doc"), "minima", "shingles"))
    sides = sides.repartition("centre", "part").sortWithinPartitions("centre", "part")
    return sides.mapInArrow(with_centre(rule), "x long, y long")


def rest_links(members: DataFrame, of_docs: DataFrame, roots: DataFrame, rule: Rule) -> DataFrame | None:
    """Steps 4 and 5: links between roots. members: centre, rep; of_docs: doc, s, shingles; roots: node, root."""
    t = rule.threshold
    members = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("centre", "rep", F.coalesce("root", "rep").alias("root"))
    several = members.groupBy("centre").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    several = written(several.select("centre"), "several")
    if several.isEmpty():
        return None
    rows = members.join(several, "centre").join(of_docs.withColumnRenamed("doc", "rep"), "rep")
    rows = written(rows.select("centre", "rep", "s", "root", F.size("shingles").alias("n"), "shingles"), "rows")
    each = rows.select("centre", "rep", "s", "root", "n", F.explode("shingles").alias("shingle"))
    shared = each.groupBy("centre", "shingle").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    shared = written(shared.select("centre", "shingle"), "shared")
    kept = each.join(shared, ["centre", "shingle"]).groupBy("centre", "rep", "s", "root", "n").agg(F.collect_list("shingle").alias("shingles"))
    kept = written(kept, "kept")
    own = kept.select("centre", "rep", "s", "root", F.col("n").cast("long"), F.size("shingles").cast("long").alias("v"))
    size_class = lambda n: F.floor(F.log(n) / float(np.log(SIZE_STEP)))
    there = own.groupBy("centre", size_class(F.col("n")).alias("f")).agg(
        F.max("v").alias("most"), F.min("n").alias("least"), F.min("root").alias("a"), F.max("root").alias("b")
    )
    there = written(there, "there")
    least = F.greatest(F.ceil(t * F.col("n") / 100), F.lit(1))
    most = F.least(F.floor(100 * F.col("n") / t), F.floor((100 + t) * F.col("v") / t) - F.col("n"))
    probes = own.withColumns({"lo": least, "hi": most}).where("lo <= hi")
    probes = probes.withColumn("f", F.explode(F.sequence(size_class(F.col("lo")), size_class(F.col("hi")))))
    meets = reach(F.col("most"), F.col("n") + F.col("least"), t) & ((F.col("a") != F.col("root")) | (F.col("b") != F.col("root")))
    alive = written(probes.join(there, ["centre", "f"]).where(meets).select("centre", "rep", "s").distinct(), "alive")
    blocks = parts(kept.join(alive, ["centre", "rep", "s"]), ["centre"], ["rep", "s"])
    blocks = blocks.withColumn("q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("of") - 1)))
    blocks = blocks.select("centre", F.least("part", "q").alias("i"), F.greatest("part", "q").alias("j"), "part", "root", F.col("n").cast("long"), "shingles")
    blocks = blocks.repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j")
    links = written(blocks.mapInArrow(across(rule), "x long, y long"), "links")
    dropped(several, rows, shared, kept, there, alive)
    return links


def components(classes: DataFrame, documents: DataFrame, rule: Rule) -> DataFrame:
    """rep, root of the classes that are linked. classes: rep, bands; documents: doc, text (whole)."""
    members = memberships(classes)
    asked = written(members.select(F.explode(F.array("centre", "rep")).alias("doc")).distinct(), "asked")
    texts = documents.join(small(asked, asked.count(), BROADCAST_ROWS), "doc", "left_semi")
    of_docs = written(texts.mapInArrow(sets(rule), "doc long, s long, minima binary, shingles array<long>"), "sets")
    roots = stars(centre_links(members, of_docs, rule))
    links = rest_links(members, of_docs.drop("minima"), roots, rule)
    dropped(members, asked, of_docs)
    if links is not None:
        joined = stars(links).withColumnsRenamed({"node": "old", "root": "new"})
        moved = roots.withColumnRenamed("root", "old").join(joined, "old", "left").select("node", F.coalesce("new", "old").alias("root"))
        alone = joined.select(F.col("old").alias("node"), F.col("new").alias("root")).join(roots.select("node"), "node", "left_anti")
        roots = moved.unionByName(alone)
    return roots.select(F.col("node").alias("rep"), "root")


def grouped(documents: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = OP6) -> DataFrame:
    """The key, n_shingles, component_id and kept of each row."""
    docs = documents.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    marks = written(docs.mapInArrow(signatures(rule), "doc long, n long, s1 long, s2 long, bands array<long>"), "signatures")
    full = marks.where((F.col("n") > 0) & F.col("doc").isNotNull())
    classes = full.groupBy("n", "s1", "s2").agg(F.min("doc").alias("rep"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    roots = components(classes.select("rep", "bands"), docs, rule)
    named = classes.select("n", "s1", "s2", "rep").join(roots, "rep", "left")
    named = written(named.select("n", "s1", "s2", F.coalesce("root", "rep").alias("root")), "named")
    # an empty set is in no class; by a hash of its id it is no hot key of the join either
    s1 = F.when(F.col("n") > 0, F.col("s1")).otherwise(F.xxhash64("doc"))
    out = marks.select("doc", "n", s1.alias("s1"), "s2").join(named, ["n", "s1", "s2"], "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("root", "doc"))
    out = out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = OP6) -> DataFrame:
    """The documents of which their group's smallest id is the own, with all their columns."""
    gone = grouped(documents, key, text, rule).where(~F.col("kept")).select(key)
    return documents.join(gone, key, "left_anti").select(*documents.columns)


def op6_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return grouped(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_near_duplicates": op6_near_duplicates}
ORACLE_SQL = {
    "op6_near_duplicates": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w),
  c AS (SELECT min(doc_id) AS rep, k, any_value(s) AS s, len(any_value(s)) AS n FROM (SELECT doc_id, s, md5(array_to_string(list_sort(s), chr(10))) AS k FROM s) WHERE len(s) > 0 GROUP BY k),
  t AS (SELECT rep, n, unnest(s) AS x FROM c),
  p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS m, any_value(a.n) AS na, any_value(b.n) AS nb FROM t a JOIN t b ON a.x = b.x AND a.rep < b.rep
      WHERE a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85 GROUP BY ALL),
  e AS (SELECT a, b FROM p WHERE 100 * m >= 85 * (na + nb - m)),
  both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  reach AS (SELECT rep AS a, rep AS b FROM c UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
  root AS (SELECT a AS rep, min(b) AS root FROM reach GROUP BY a),
  k AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS k FROM s)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, CASE WHEN k.n = 0 THEN k.doc_id ELSE root.root END AS component_id,
  k.doc_id = CASE WHEN k.n = 0 THEN k.doc_id ELSE root.root END AS kept
FROM k LEFT JOIN c ON k.k = c.k AND k.n > 0 LEFT JOIN root ON c.rep = root.rep"""
}
