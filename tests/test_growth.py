"""What keeps the work of a query in proportion to its tables."""

import random
import time

from pyspark.sql import functions as F

from orrery.operators import graph, postings, retrieval
from orrery.plans import features
from orrery.sources.parsers import Scopes

SF = "/root/testdata/sf0.001"


def test_scopes_find_the_innermost_without_a_pass_over_all():
    rng = random.Random(3)
    for _ in range(200):
        s = Scopes()
        s.owners = [(a := rng.randrange(30), a + rng.randrange(-1, 12), k + 1) for k in range(rng.randrange(12))]
        s.types = [(a, b, rng.choice("xy"), rng.choice("PQ")) for a, b, _ in s.owners]
        for i in range(-1, 45):
            inside = [(b - a, k) for a, b, k in s.owners if a <= i <= b]
            assert s.owner(i) == (min(inside)[1] if inside else None)
            typed = [(b - a, t) for a, b, n, t in s.types if n == "x" and a <= i <= b]
            assert s.type(i, "x") == (min(typed)[1] if typed else None)
    s, began = Scopes(), time.process_time()
    s.owners = [(10 * k, 10 * k + 9, k + 1) for k in range(30000)]
    assert [s.owner(10 * k + 5) for k in range(30000)] == list(range(1, 30001)) and time.process_time() - began < 5


def test_sources_are_dealt_over_tasks(spark):
    assert features.sources(spark, SF).rdd.getNumPartitions() == features.MODULES


def test_pick_unique_joins_counts_and_not_candidates(spark):
    # every site's name has all the candidates: 20,000 x 20,000 pairs, of which none may be listed
    sites = spark.range(20000).select(F.col("id").alias("site_id"), F.lit("f").alias("name"), F.col("id").cast("int").alias("argc"))
    many = spark.range(20000).select("id", F.lit("f").alias("name"), F.col("id").cast("int").alias("sig_argc"))
    began = time.monotonic()
    got = graph.pick_unique(sites, many).agg(F.count("*"), F.count_if(F.col("site_id") == F.col("dst"))).first()
    assert tuple(got) == (20000, 20000) and time.monotonic() - began < 30
    # a site of two rows, unknown counts on either side
    sites = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "a", None), (3, "b", 7), (4, "b", None), (5, "c", 1), (6, None, 1), (7, "d", 4)], "site_id long, name string, argc int")
    found = spark.createDataFrame([(10, "a", 1), (11, "a", None), (12, "b", None), (13, "c", 2), (14, None, 1), (15, "d", 4), (16, "d", None)], "id long, name string, sig_argc int")
    assert sorted(map(tuple, graph.pick_unique(sites, found).collect())) == [(1, 10), (3, 12), (4, 12), (7, 15)]


def test_bm25_reads_the_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    chunks = spark.createDataFrame([(1, "que thing"), (2, "Qué étude que"), (3, "none")], "chunk_id long, content string").mapInArrow(counted, "chunk_id long, content string")
    assert {r.chunk_id for r in retrieval.bm25(chunks, ["que", "thing"], None).collect()} == {1, 2} and seen.value == 3


def test_postings_are_counted_where_the_text_is(spark, tmp_path):
    rows = [(1, "a b a"), (2, "b Ä"), (2, "c b"), (3, " ,"), (4, None), (5, ""), (5, "x")]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string")
    assert sorted(map(tuple, retrieval.posting_counts(chunks).collect())) == [(1, 2, 3), (2, 3, 4), (5, 1, 1)]
    postings.write(chunks, str(tmp_path))
    posts, _ = postings.read(spark, str(tmp_path))
    want = sorted((r.term, r.chunk_id, r.tf) for r in retrieval.postings(chunks).collect())
    assert sorted((r.term, r.chunk_id, r.tf) for r in posts.collect()) == want and ("a", 1, 2) in want
