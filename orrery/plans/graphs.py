"""Queries over the code graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import graph
from orrery.plans import views as V
from orrery.session import table

SITES = """SELECT * FROM (VALUES (1, 'save', 2), (2, 'save', 3), (3, 'load', 1), (4, 'load', CAST(NULL AS INT)), (5, 'gone', 0), (6, 'one', 4), (7, 'dup', 1)) AS t(site_id, name, argc)"""
CANDIDATES = """SELECT * FROM (VALUES (10, 'save', 2), (11, 'save', 2), (12, 'save', 3), (13, 'load', 1), (14, 'one', 5), (15, 'dup', 1), (16, 'dup', 1)) AS t(id, name, sig_argc)"""
STEP1 = """SELECT * FROM (VALUES (1, 10), (2, CAST(NULL AS INT))) AS t(site_id, dst)"""
STEP2 = """SELECT * FROM (VALUES (1, 20), (2, 21), (3, 22)) AS t(site_id, dst)"""
STEP3 = """SELECT * FROM (VALUES (3, 30), (4, 31), (5, CAST(NULL AS INT))) AS t(site_id, dst)"""
IMPORT_PATHS = """SELECT * FROM (VALUES ('r1', 0, 'a/b.py'), ('r1', 1, 'a/b/__init__.py'), ('r2', 0, 'c.py'), ('r2', 1, 'c/__init__.py'), ('r3', 0, 'none.py')) AS t(ref, priority, path)"""
IMPORT_MODULES = """SELECT * FROM (VALUES ('a/b.py', 1), ('a/b/__init__.py', 2), ('c/__init__.py', 3)) AS t(path, id)"""
RAW_SYMBOLS = """SELECT * FROM (VALUES (1, 0, 'A#f', 3), (1, 1, 'A#f', 9), (1, 2, 'A#g', 12), (1, 3, 'A#f', 20), (2, 0, 'A#f', 5)) AS t(file_id, idx, qname, line_start)"""


def _modules(spark, sf):
    """Suppliers and customers as files of their nation's module."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("file_id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("module"))
    return s


CALL_SQL = f"""SELECT e.src, a.qname AS src_name, fa.path AS src_path, e.dst, b.qname AS dst_name, fb.path AS dst_path, e.resolution, e.line
  FROM ({V.EDGES}) e JOIN ({V.SYMBOLS}) a ON a.id = e.src JOIN ({V.PATHS}) fa ON fa.file_id = a.file_id JOIN ({V.SYMBOLS}) b ON b.id = e.dst JOIN ({V.PATHS}) fb ON fb.file_id = b.file_id"""


def _seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def _definition(pattern: str):
    return lambda spark, sf: graph.find_symbols(V.symbols(spark, sf), pattern).select("id", "qname", "tier")


def _definition_sql(pattern: str, tail: str) -> str:
    third = f"WHEN name = '{tail}' OR contains(qname, '{pattern}') THEN 3" if "." in pattern or "#" in pattern else ""
    return f"""WITH t AS (SELECT id, qname, CASE WHEN qname = '{pattern}' THEN 1 WHEN name = '{pattern}' THEN 2 {third} END AS tier FROM ({V.SYMBOLS}) WHERE kind <> 'module')
      SELECT id, qname, tier FROM t WHERE tier = (SELECT min(tier) FROM t) ORDER BY qname, id LIMIT 50"""


def _segments(spark, sf):
    return graph.segment(_segment_files(spark, sf)).groupBy("module").agg(F.count("*").alias("files"))


def _segment_files(spark, sf):
    d = V.files(spark, sf)
    return d.select(F.concat_ws("/", "repo", (F.col("file_id") % 3).cast("string"), F.col("file_id").cast("string")).alias("path"), "hash")


SEGMENT_SQL = f"""WITH f AS (SELECT repo || '/' || (file_id % 3) || '/' || file_id AS path FROM ({V.FILES})),
  one AS (SELECT path, split_part(path, '/', 1) AS m, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS d FROM f),
  s AS (SELECT m, count(*) AS n FROM one GROUP BY m),
  two AS (SELECT CASE WHEN n > 60 THEN d ELSE m END AS m, path FROM one JOIN s USING (m)),
  t AS (SELECT m, count(*) AS n FROM two GROUP BY m),
  p AS (SELECT m, n, string_split(m, '/') AS s FROM t),
  near AS (SELECT a.m AS small, b.m AS big, (SELECT max(i) FROM range(1, 60) r(i) WHERE i <= len(a.s) AND i <= len(b.s) AND a.s[1:i] = b.s[1:i]) AS l FROM p a JOIN p b ON a.s[1] = b.s[1] WHERE a.n < 5 AND b.n >= 5),
  own AS (SELECT small, arg_min(big, (-l, big)) AS big FROM near GROUP BY small),
  into_ AS (SELECT * FROM own UNION ALL SELECT m, min(m) OVER (PARTITION BY s[1]) FROM p WHERE n < 5 AND m NOT IN (SELECT small FROM own))
  SELECT coalesce(big, m) AS module, count(*) AS files FROM two LEFT JOIN into_ ON small = m GROUP BY 1"""

CATALOG = {
    "edge_stats": (lambda s, sf: graph.resolution_counts(V.edges(s, sf)), f"SELECT coalesce(resolution, 'unknown') AS resolution, count(*) AS edges FROM ({V.EDGES}) GROUP BY 1"),
    "definition_name": (_definition("red widget"), _definition_sql("red widget", "red widget")),
    "definition_tail": (_definition("Brand#2.hot"), _definition_sql("Brand#2.hot", "hot")),
    "callers_of": (lambda s, sf: graph.callers(V.edges(s, sf), V.symbols(s, sf), V.paths(s, sf), 42), f"{CALL_SQL} WHERE e.dst = 42"),
    "callees_of": (lambda s, sf: graph.callees(V.edges(s, sf), V.symbols(s, sf), V.paths(s, sf), 42), f"{CALL_SQL} WHERE e.src = 42"),
    "impact_bfs": (
        lambda s, sf: graph.impact(V.edges(s, sf), _seed(s, 42), 3),
        f"""WITH RECURSIVE e AS ({V.EDGES}), r AS (SELECT CAST(42 AS BIGINT) AS node, 0 AS depth UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 3)
        SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node HAVING min(depth) > 0""",
    ),
    "indegree_top": (
        lambda s, sf: graph.in_degree(V.edges(s, sf)).orderBy(F.desc("in_degree"), "id").limit(20),
        f"SELECT dst AS id, count(*) AS in_degree FROM ({V.EDGES}) GROUP BY 1 ORDER BY in_degree DESC, id LIMIT 20",
    ),
    "dependents": (
        lambda s, sf: graph.dependents(V.edges(s, sf), V.symbols(s, sf), s.createDataFrame([(1,), (2,)], "file_id int")),
        f"""SELECT DISTINCT a.file_id FROM ({V.EDGES}) e JOIN ({V.SYMBOLS}) a ON a.id = e.src JOIN ({V.SYMBOLS}) b ON b.id = e.dst WHERE b.file_id IN (1, 2) AND a.file_id NOT IN (1, 2)""",
    ),
    "module_graph_top20": (
        lambda s, sf: graph.module_graph(V.imports(s, sf), _modules(s, sf)),
        f"""WITH m AS (SELECT s_suppkey AS file_id, 'n' || s_nationkey AS module FROM supplier)
        SELECT a.module AS src_module, b.module AS dst_module, CAST(count(*) AS BIGINT) AS imports FROM ({V.IMPORTS}) i JOIN m a ON a.file_id = i.src_file JOIN m b ON b.file_id = i.dst_file
        WHERE a.module <> b.module GROUP BY ALL ORDER BY imports DESC, src_module, dst_module LIMIT 20""",
    ),
    "neighbours": (
        lambda s, sf: graph.neighbours(V.edges(s, sf), _seed(s, 1, 2, 3)),
        f"SELECT DISTINCT CASE WHEN src IN (1, 2, 3) THEN dst ELSE src END AS node FROM ({V.EDGES}) WHERE (src IN (1, 2, 3)) <> (dst IN (1, 2, 3))",
    ),
    "segment_modules": (_segments, SEGMENT_SQL),
    "module_hash": (
        lambda s, sf: graph.module_hash(graph.clusters(V.files(s, sf))),
        f"SELECT repo AS module, count(*) AS files, md5(string_agg(hash, chr(10) ORDER BY hash)) AS source_hash FROM ({V.FILES}) GROUP BY 1",
    ),
    "pick_unique": (
        lambda s, sf: graph.pick_unique(V.values(s, SITES), V.values(s, CANDIDATES)),
        f"""SELECT site_id, CASE WHEN n = 1 THEN only_ ELSE match END AS dst FROM (SELECT site_id, count(*) AS n, count(*) FILTER (argc = sig_argc) AS eq, count(*) FILTER (argc <> sig_argc) AS ne, min(id) AS only_,
        min(id) FILTER (argc = sig_argc) AS match FROM ({SITES}) JOIN ({CANDIDATES}) USING (name) GROUP BY site_id) WHERE (n = 1 AND ne = 0) OR (n > 1 AND eq = 1)""",
    ),
    "pick_unique_parts": (
        lambda s, sf: graph.pick_unique(
            table(s, sf, "orders").select(F.col("o_orderkey").alias("site_id"), F.concat(F.lit("c"), (F.col("o_custkey") % 997).cast("string")).alias("name"), (F.col("o_orderkey") % 50).cast("int").alias("argc")),
            table(s, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("c"), (F.col("p_partkey") % 1999).cast("string")).alias("name"), F.col("p_size").alias("sig_argc")),
        ),
        """SELECT site_id, CASE WHEN n = 1 THEN only_ ELSE match END AS dst FROM (SELECT o_orderkey AS site_id, count(*) AS n, count(*) FILTER (o_orderkey % 50 = p_size) AS eq,
        count(*) FILTER (o_orderkey % 50 <> p_size) AS ne, min(p_partkey) AS only_, min(p_partkey) FILTER (o_orderkey % 50 = p_size) AS match
        FROM orders JOIN part ON o_custkey % 997 = p_partkey % 1999 GROUP BY o_orderkey) WHERE (n = 1 AND ne = 0) OR (n > 1 AND eq = 1)""",
    ),
    "cascade_resolve": (
        lambda s, sf: graph.cascade(V.values(s, SITES), [("own class", V.values(s, STEP1)), ("import", V.values(s, STEP2)), ("same file", V.values(s, STEP3))]),
        f"""WITH h AS (SELECT site_id, dst, 1 AS k, 'own class' AS reason FROM ({STEP1}) UNION ALL SELECT site_id, dst, 2, 'import' FROM ({STEP2}) UNION ALL SELECT site_id, dst, 3, 'same file' FROM ({STEP3}))
        SELECT site_id, dst, reason FROM h WHERE k = (SELECT min(k) FROM h g WHERE g.site_id = h.site_id) AND dst IS NOT NULL""",
    ),
    "ambiguous_fqcn": (
        lambda s, sf: graph.unique_by_name(table(s, sf, "part").select(F.concat_ws(".", "p_brand", "p_name").alias("name"), F.col("p_partkey").alias("id"))),
        "SELECT p_brand || '.' || p_name AS name, min(p_partkey) AS id FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1",
    ),
    "import_candidates": (
        lambda s, sf: graph.first_candidate(V.values(s, IMPORT_PATHS), V.values(s, IMPORT_MODULES)),
        f"SELECT ref, arg_min(id, priority) AS id FROM ({IMPORT_PATHS}) JOIN ({IMPORT_MODULES}) USING (path) GROUP BY ref",
    ),
    "ordinal_names": (
        lambda s, sf: graph.ordinal_names(V.values(s, RAW_SYMBOLS)),
        f"SELECT file_id, idx, CASE WHEN row_number() OVER (PARTITION BY file_id, qname ORDER BY idx) > 1 THEN qname || '@' || line_start ELSE qname END AS qname, line_start FROM ({RAW_SYMBOLS})",
    ),
    "sample_edges": (lambda s, sf: graph.sample_edges(V.edges(s, sf), 30, seed=7), None),
}
