"""The code-graph tables, as views of the test tables: once as DataFrames, once as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.session import table


def values(spark: SparkSession, sql: str) -> DataFrame:
    """A literal table, from the same text that the oracle uses."""
    return spark.sql(sql)


def files(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("file_id"), F.col("source").alias("repo"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.md5("text").alias("hash"), F.col("n_chars").alias("size"))


FILES = "SELECT doc_id AS file_id, source AS repo, source || '/' || doc_id AS path, md5(text) AS hash, n_chars AS size FROM documents"


def chunks(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "content"))
    d = d.where(F.trim("content") != "").withColumn("ord", F.col("i") + 1)
    return d.select((F.col("doc_id") * 100000 + F.col("ord")).alias("chunk_id"), F.col("doc_id").alias("file_id"), "ord", "content")


CHUNKS = """SELECT doc_id * 100000 + ord AS chunk_id, doc_id AS file_id, CAST(ord AS INTEGER) AS ord, content FROM
  (SELECT doc_id, unnest(l) AS content, unnest(range(1, len(l) + 1)) AS ord FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
  WHERE trim(content) <> ''"""


def edges(spark, sf) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    e = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.when(F.col("l_returnflag") == "N", "exact").otherwise("heuristic").alias("r"), F.col("l_linenumber").alias("n")
    )
    return e.where(F.col("dst").isNotNull()).groupBy("src", "dst").agg(F.min("r").alias("resolution"), F.min("n").alias("line"))


EDGES = """SELECT src, dst, min(r) AS resolution, min(n) AS line FROM (SELECT l_partkey AS src, lead(l_partkey) OVER
  (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst,
  CASE WHEN l_returnflag = 'N' THEN 'exact' ELSE 'heuristic' END AS r, l_linenumber AS n FROM lineitem) WHERE dst IS NOT NULL GROUP BY ALL"""


def symbols(spark, sf) -> DataFrame:
    qname = F.concat(F.col("p_brand"), F.lit("."), F.col("p_name"), F.lit("@"), F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), qname.alias("qname"), F.when(F.col("p_partkey") % 10 == 0, "interface").otherwise("function").alias("kind"), F.col("p_size").alias("file_id"))


SYMBOLS = "SELECT p_partkey AS id, p_name AS name, p_brand || '.' || p_name || '@' || p_partkey AS qname, CASE WHEN p_partkey % 10 = 0 THEN 'interface' ELSE 'function' END AS kind, p_size AS file_id FROM part"


def paths(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_size").alias("file_id")).distinct().withColumn("path", F.concat(F.lit("src/"), F.col("file_id").cast("string"), F.lit(".py")))


PATHS = "SELECT DISTINCT p_size AS file_id, 'src/' || p_size || '.py' AS path FROM part"


def imports(spark, sf) -> DataFrame:
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("l_suppkey").alias("src_file"), F.col("o_custkey").alias("dst_file")).distinct()


IMPORTS = "SELECT DISTINCT l_suppkey AS src_file, o_custkey AS dst_file FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def usage(spark, sf) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("stage"), F.concat(F.lit("model-"), (k % 5).cast("string")).alias("model"), k.alias("prompt_tokens"), (k * 2).alias("completion_tokens"), F.col("value").alias("cost")
    )


USAGE = """SELECT event_type AS stage, 'model-' || (k % 5) AS model, k AS prompt_tokens, k * 2 AS completion_tokens, value AS cost
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""

# Schema audit: literal tables shared by both sides.
TABLES = """SELECT * FROM (VALUES ('shop', 't_order', 4000), ('shop', 't_item', 900000), ('shop', 't_no_pk', 10), ('shop', 't_tmp_scratch', 5),
  ('crm', 't_user', 120000), ('crm', 't_event', CAST(NULL AS INT))) AS t(schema, "table", row_count)"""
COLUMNS = """SELECT * FROM (VALUES ('shop', 't_order', 'id', true, 4000, 0.0), ('shop', 't_order', 'biz_no', false, 4000, 0.0), ('shop', 't_order', 'org_code', false, 30, 0.2),
  ('shop', 't_order', 'status', false, 4, 0.95), ('shop', 't_order', 'memo', false, 3000, 0.1), ('shop', 't_item', 'id', true, 900000, 0.0), ('shop', 't_item', 'order_id', false, 4000, 0.0),
  ('shop', 't_item', 'sku', false, 700, 0.1), ('shop', 't_no_pk', 'code', false, 10, 0.1), ('shop', 't_tmp_scratch', 'x', false, 5, 0.99),
  ('crm', 't_user', 'id', true, 120000, 0.0), ('crm', 't_user', 'phone', false, 119000, 0.0), ('crm', 't_user', 'deleted', false, 2, 0.97), ('crm', 't_event', 'user_id', false, 100, 0.1))
  AS t(schema, "table", "column", is_pk, cardinality, top_share)"""
INDEXES = """SELECT schema, "table", "index", {split} AS columns, is_unique, cardinality FROM (VALUES ('shop', 't_order', 'uk_biz_no', 'biz_no', true, 4000), ('shop', 't_order', 'idx_status_org', 'org_code,status', false, 90),
  ('shop', 't_order', 'idx_org', 'org_code', false, 30), ('shop', 't_order', 'idx_status', 'status', false, 4), ('shop', 't_order', 'idx_memo', 'memo,org_code,status', false, 3000),
  ('shop', 't_item', 'idx_sku', 'sku', false, 700), ('crm', 't_user', 'idx_deleted', 'deleted', false, 2), ('crm', 't_user', 'idx_del_phone', 'deleted,phone', true, 119000))
  AS t(schema, "table", "index", cs, is_unique, cardinality)"""
ACCESSES = """SELECT * FROM (VALUES ('q1', 'A.xml:3', 't_order', 'status', 'where', 2), ('q1', 'A.xml:3', 't_order', 'memo', 'where', 2), ('q2', 'B.xml:9', 't_item', 'order_id', 'where', 1),
  ('q3', 'B.xml:30', 't_item', 'order_id', 'where', 2), ('q4', 'C.java:7', 't_item', 'order_id', 'join', 1), ('q4', 'C.java:7', 't_order', 'id', 'join', 1), ('q5', 'D.java:1', 't_no_pk', 'code', 'where', 1),
  ('q6', 'D.java:4', 't_user', 'phone', 'where', 5), ('q10', 'D.java:5', 't_no_pk', 'code', 'where', 0), ('q11', 'D.java:6', 't_no_pk', 'code', 'where', CAST(NULL AS INT)), ('q7', 'D.java:8', 't_event', 'user_id', 'where', 9), ('q7', 'D.java:9', 't_event', 'user_id', 'join', 9), ('q8', 'E.java:1', 't_tmp_scratch', 'x', 'where', 9),
  ('q9', 'E.java:2', 't_order', 'nothere', 'where', 9)) AS t(fingerprint, location, "table", "column", usage, freq)"""
PATTERNS = """SELECT * FROM (VALUES ('t_order', 'memo', 'leading wildcard', 'q1'), ('t_order', 'memo', 'leading wildcard', 'q1'), ('t_order', 'status', 'leading wildcard', 'q1'), ('t_user', 'phone', 'function on column', 'q6'), ('t_other', 'x', 'leading wildcard', 'q7')) AS t("table", "column", kind, fingerprint)"""
SLOW = """SELECT * FROM (VALUES ('shop', 't_order', 's1', 2500000, 6), ('shop', 't_item', 's2', 90000, 8), ('crm', 't_user', 's3', 500, 1), ('crm', 't_user', 's4', 1500, 0), ('crm', 't_user', 's5', 2001, 2), ('crm', 't_user', 's6', 20001, 2), ('crm', 't_user', 's7', 1000, 1)) AS t(schema, "table", fingerprint, rows_scanned, rows_returned)"""
#: DuckDB quotes reserved words, Spark uses backticks.
DUCK_INDEXES = INDEXES.format(split="string_split(cs, ',')")


def audit(spark, *names: str) -> list[DataFrame]:
    every = {"tables": TABLES, "columns": COLUMNS, "indexes": INDEXES.format(split="split(cs, ',')"), "accesses": ACCESSES, "patterns": PATTERNS, "slow": SLOW}
    return [values(spark, every[n].replace('"', "`")) for n in names]


AUDIT_WITH = f"""tables AS ({TABLES}), columns AS ({COLUMNS}), indexes AS ({DUCK_INDEXES}), accesses AS ({ACCESSES}), patterns AS ({PATTERNS}), slow AS ({SLOW}),
  lasting AS (SELECT * FROM tables WHERE NOT regexp_matches(lower("table"), 'temp|tmp')),
  indexed AS (SELECT DISTINCT schema, "table", "column" FROM (SELECT schema, "table", unnest(columns) AS "column" FROM indexes UNION ALL SELECT schema, "table", "column" FROM columns WHERE is_pk)),
  known AS (SELECT c.schema, c."table", c."column" FROM columns c JOIN lasting l ON c.schema = l.schema AND c."table" = l."table"),
  used AS (SELECT k.schema, a.* FROM accesses a JOIN known k ON a."table" = k."table" AND a."column" = k."column"),
  bare AS (SELECT * FROM used u WHERE NOT EXISTS (SELECT 1 FROM indexed i WHERE i.schema = u.schema AND i."table" = u."table" AND i."column" = u."column"))"""
