import math

import numpy as np
from pyspark.sql import functions as F

from orrery.llm import ann


def brute(rows, k):
    own = {i: np.array(v, np.float64) for i, v in rows}
    out = {}
    for q, v in own.items():
        if q % 20 == 0:
            near = sorted(((-float(np.dot(v, w)), i) for i, w in own.items() if i != q))[:k]
            out[q] = [i for _, i in near]
    return out


def test_recall_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = {}
    for r in ann.op8_nearest(spark, "/root/testdata/sf0.01").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    rows = [(r.vec_id, r.embedding) for r in docs.collect()]
    want = brute(rows, 20)
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_scores_ties_and_odd_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [-1.0, 2.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [2.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, id string, score int")
    got = [tuple(r) for r in ann.search(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 2.0), (0, 2, 1, 0.5), (0, 3, 2, 0.5), (0, 4, 8, -1.0), (20, 1, 0, 2.0), (20, 2, 1, 1.0), (20, 3, 2, 1.0), (20, 4, 8, 0.0)]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(df, F.col("id") % 20 == 0).count() == 0


def hot(n, copies, seed=5):
    """n rows of 16 dimensions, of which ``copies``, with ids dealt at random, are equal."""
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 16)), 3).astype(np.float32)
    x[r.permutation(n)[:copies]] = np.round(r.normal(size=16), 3) * 2
    return [(i, list(map(float, v))) for i, v in enumerate(x)]


def test_thousands_of_copies_keep_the_smallest_ids(spark):
    rows = hot(9000, 3000)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    got = {}
    for r in ann.search(df, F.col("id") % 200 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    x = np.array([v for _, v in rows], np.float64)
    want = {}
    for q in range(0, len(rows), 200):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        want[q] = np.lexsort((np.arange(len(s)), -s))[:20].tolist()
    of_copies = [q for q in want if len({tuple(x[i]) for i in want[q]}) == 1]
    assert len(of_copies) >= 10 and all(got[q] == want[q] for q in of_copies)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 20 * len(want)


def test_repeated_ids_among_copies(spark):
    rows = [(0, [1.0, 0.0])] * 30 + [(i, [1.0, 0.0]) for i in range(1, 31)] + [(0, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = [r.vec_id for r in ann.search(df, F.col("id") == 0).orderBy("rank").collect()]
    assert got == list(range(1, 21))


def test_recall_over_many_tasks_and_passes(spark, monkeypatch):
    """Where product codes decide what is scored exactly: with clusters few lists are probed, without any most are."""
    monkeypatch.setattr(ann, "QUERY_BLOCK", 40)
    r = np.random.default_rng(9)
    for clustered in (True, False):
        centres = r.normal(size=(60, 32)) * (4 if clustered else 0)
        x = (centres[r.integers(0, 60, 12_000)] + r.normal(size=(12_000, 32))).astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
        got = {}
        for row in ann.search(df, F.col("id") % 100 == 0, rerank=300).orderBy("query_id", "rank").collect():
            got.setdefault(row.query_id, []).append(row.vec_id)
        y, hits = x.astype(np.float64), 0
        for q in range(0, 12_000, 100):
            s = y @ y[q]
            s[q] = -np.inf
            hits += len(set(np.argsort(-s)[:20].tolist()) & set(got[q]))
        assert hits >= 0.9 * 20 * 120
        index, probes = ann.build(df.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")), 20)
        assert (probes <= 0.5 * len(index.coarse)) == clustered


def test_queries_of_repeated_ids(spark):
    rows = [(0, [2.0, 0.0]), (0, [1.0, 5.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.search(df, F.col("id") == 0).orderBy("rank").collect()] == [(0, 1, 2, 5.0), (0, 2, 1, 1.0)]
