"""What the rules, the segmentation and the fusion give on small cases whose results are worked out by hand."""

import pytest
from pyspark.sql import functions as F

from orrery.operators import audit, graph
from orrery.operators import retrieval as R


def modules(spark, paths):
    df = spark.createDataFrame([(p, "h") for p in paths], "path string, hash string")
    return {r.module: r.n for r in graph.segment(df).groupBy("module").agg(F.count("*").alias("n")).collect()}


@pytest.mark.parametrize(
    ("paths", "want"),
    [
        # no part in common: nobody takes it in, however near the letters
        ([f"alpha/f{i}" for i in range(6)] + ["alpine/x", "zeta/x", "top.java"], {"alpha": 6, "alpine": 1, "zeta": 1, "top.java": 1}),
        # split one level deeper; small parts join the first large one of the same first part
        ([f"a/{k}/f{i}" for k in "xy" for i in range(40)] + ["a/z/f", "a/readme"], {"a/x": 42, "a/y": 40}),
        # no large part: the first small one takes in the others
        ([f"a/{i:02}/f" for i in range(61)], {"a/00": 61}),
    ],
)
def test_segments(spark, paths, want):
    assert modules(spark, paths) == want


def test_slow_query_ratio_is_not_rounded(spark):
    rows = [("s", "t", f"q{i}", scanned, returned) for i, (scanned, returned) in enumerate([(2001, 2), (1000, 1), (20001, 2), (10000, 1), (5000, 0)])]
    got = audit.qry101(spark.createDataFrame(rows, "schema string, table string, fingerprint string, rows_scanned long, rows_returned long"))
    assert sorted((r.severity, r.evidence) for r in got.collect()) == [("high", "q2|10000"), ("medium", "q0|1000"), ("medium", "q3|10000"), ("medium", "q4|5000")]


def test_frequencies_severities_and_columns(spark):
    df = spark.createDataFrame
    tables = df([("s", "t", 9)], "schema string, table string, row_count long")
    columns = df([("s", "t", c) for c in "ab"], "schema string, table string, column string").withColumn("is_pk", F.lit(False))
    indexes = df([], "schema string, table string, columns array<string>")
    uses = [("q1", "f:1", "t", "a", "where", None), ("q2", "f:2", "t", "a", "where", 0), ("q3", "f:3", "t", "a", "where", 1), ("q3", "f:3", "t", "b", "join", 1)]
    uses = df(uses, "fingerprint string, location string, table string, column string, usage string, freq long")
    assert [(r.severity, r.evidence) for r in audit.idx001(tables, columns, indexes, uses).collect()] == [("high", "a|3|3|f:1,f:2,f:3")]
    assert [(r.severity, r.evidence) for r in audit.idx004(tables, columns, indexes, uses).collect()] == [("medium", "b|q3")]
    found = df([("t", "a", "wild", "q1"), ("t", "b", "wild", "q1"), ("t", "b", "wild", "q1")], "table string, column string, kind string, fingerprint string")
    assert sorted(r.evidence for r in audit.idx005(tables, found).collect()) == ["a|wild|q1", "b|wild|q1"]


def test_fused_ties_go_to_the_first_list_and_rank(spark):
    df = lambda rows, name, off=0: spark.createDataFrame(rows, "chunk_id long, rank long").withColumns({"source": F.lit(name), "off": F.lit(off)})
    fused = R.fuse(df([(9, 0), (3, 1)], "vector"), df([(1, 0), (3, 1)], "fts"), df([(2, 0)], "graph", 120))
    assert [(r.chunk_id, r.sources) for r in R.best(fused, 9).collect()] == [(3, "fts,vector"), (9, "vector"), (1, "fts"), (2, "graph")]


def test_similarity_is_never_negative(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 2.0]), (4, [0.0, 0.0])], "chunk_id long, vector array<double>")
    query = F.array(F.lit(1.0), F.lit(0.0))
    assert [(r.chunk_id, r.sim) for r in R.nearest(vectors, query).collect()] == [(1, 1.0), (3, 0.0), (2, 0.0)]
    assert [r.chunk_id for r in R.nearest(vectors, query, least=0.25).collect()] == [1]
