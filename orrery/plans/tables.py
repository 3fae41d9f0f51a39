"""Queries on stored tables: usage, changes, caches, and scalar functions over text."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.operators import store, usage
from orrery.plans import views as V
from orrery.session import table

PRICES = """SELECT * FROM (VALUES ('model', 1.0), ('model-1', 2.5), ('model-12', 9.0), ('other', 4.0)) AS t(prefix, price)"""
MODELS = """SELECT * FROM (VALUES ('model-0'), ('model-1'), ('model-12x'), ('mod'), ('other-9')) AS t(model)"""
STATUS = """SELECT * FROM (VALUES ('A{t}new.py'), ('D{t}old.py'), ('M{t}same.py'), ('R100{t}a.py{t}b.py'), ('C75{t}c.py{t}d.py'), ('T{t}link')) AS t(line)"""
SQLS = """SELECT * FROM (VALUES (1, 'SELECT * FROM T_Order o JOIN `crm`.`T_user` u ON o.id = u.id WHERE a = ''x'' AND b > 12.5'), (2, 'update shop.t_item SET n = 7  WHERE   id=3'), (3, 'no tables here'),
  (4, 'insert into t_a select 1 from t_b')) AS t(id, sql)"""
DYNAMIC = """SELECT * FROM (VALUES (1, 'SELECT * FROM t <where> <if test="a">AND a = #{{a}}</if> </where>'), (2, 'UPDATE t <set> a = #{{x}}, </set>'), (3, 'AND b = 1 -- note'), (4, 'SELECT 1,  ')) AS t(id, body)"""
QUESTIONS = """SELECT * FROM (VALUES (1, 'How does parseHTTPRequest2 handle user_name?'), (2, 'UserService and the totals of OrderRepo'), (3, '核保规则 where'), (4, ''), (5, 'snake_case_name X a B12')) AS t(id, q)"""
PATHS = """SELECT * FROM (VALUES ('a/B.java'), ('x.PY'), ('y.tsx'), ('README.md'), ('Makefile'), ('q.unknown'), ('m.go')) AS t(path)"""
CONTROL = """SELECT id, {chr} AS head FROM (VALUES (1, 0), (2, 5), (3, 50)) AS t(id, n)"""
SIGNATURES = """SELECT * FROM (VALUES (1, 'void f()'), (2, 'int g(Map<String, List<Integer>> m, int[] a)'), (3, 'h(a, b(c, d), e)'), (4, 'no brackets'), (5, 'bad(a, (b)'), (6, 'x( )')) AS t(id, sig)"""
CELLS = """SELECT * FROM (VALUES (1, ' 1,234 '), (2, '5.5'), (3, 'n/a'), (4, '')) AS t(id, cell)"""
EMB_MODEL = "'m1'"


def _status_counts(s, sf):
    names = ("customer", "documents", "embeddings", "lineitem", "orders", "part")
    out = None
    for n in names:
        one = table(s, sf, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _known(s, sf):
    """The files as an earlier run knew them: every seventh unknown, every fifth with another hash, every third with another time."""
    f = V.files(s, sf)
    return f.where("file_id % 7 <> 0").select(
        F.col("path").alias("rel"), F.when(F.col("file_id") % 5 == 0, F.md5("hash")).otherwise(F.col("hash")).alias("hash"), (F.col("size") + (F.col("file_id") % 3 == 0).cast("int")).cast("double").alias("mtime")
    ).unionByName(f.where("file_id % 50 = 0").select(F.concat(F.col("path"), F.lit(".gone")).alias("rel"), "hash", F.col("size").cast("double").alias("mtime")))


KNOWN = f"""SELECT path AS rel, CASE WHEN file_id % 5 = 0 THEN md5(hash) ELSE hash END AS hash, CAST(size + CASE WHEN file_id % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS mtime FROM ({V.FILES}) WHERE file_id % 7 <> 0
  UNION ALL SELECT path || '.gone', hash, CAST(size AS DOUBLE) FROM ({V.FILES}) WHERE file_id % 50 = 0"""


def _scan(s, sf):
    return V.files(s, sf).select(F.col("path").alias("rel"), "hash", F.col("size").cast("double").alias("mtime"))


def _cascade(s, sf):
    gone = V.files(s, sf).where("repo = 'src0'").select("file_id")
    e = V.chunks(s, sf).select(F.col("file_id").alias("src_file"), (F.col("file_id") + 1).alias("dst_file"))
    left = store.cascade_delete(gone, chunks=V.chunks(s, sf).select("file_id", "chunk_id"), edges=e)
    return left["chunks"].agg(F.count("*").alias("chunks")).crossJoin(left["edges"].agg(F.count("*").alias("edges")))  # one row each


def _cache(s, sf):
    c = V.chunks(s, sf).select(F.md5("content").alias("content_hash"), F.lit("m1").alias("model"))
    cache = c.where("substring(content_hash, 1, 1) < '8'").distinct()
    return store.cache_lookup(c, cache).groupBy("hit").agg(F.count("*").alias("n"))


CHAR = "CASE WHEN n = 0 THEN 'plain text' || chr(10) || 'x' WHEN n = 5 THEN 'abcd' || chr(1) || 'efgh' ELSE chr(1) || chr(2) || 'x' END"
CATALOG = {
    "status_counts": (_status_counts, " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("customer", "documents", "embeddings", "lineitem", "orders", "part"))),
    "usage_by_stage": (
        lambda s, sf: usage.summary(V.usage(s, sf), "stage"),
        f"SELECT stage, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(sum(cost), 4) AS cost FROM ({V.USAGE}) GROUP BY stage",
    ),
    "usage_by_model": (
        lambda s, sf: usage.summary(V.usage(s, sf), "model"),
        f"SELECT model, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(sum(cost), 4) AS cost FROM ({V.USAGE}) GROUP BY model",
    ),
    "usage_total": (lambda s, sf: usage.total(V.usage(s, sf)), f"SELECT round(coalesce(sum(cost), 0), 4) AS total_cost FROM ({V.USAGE})"),
    "price_match": (
        lambda s, sf: usage.price_match(V.values(s, MODELS), V.values(s, PRICES)).withColumn("price", F.col("price").cast("double")),
        f"SELECT model, arg_max(prefix, length(prefix)) AS prefix, CAST(arg_max(price, length(prefix)) AS DOUBLE) AS price FROM ({MODELS}) LEFT JOIN ({PRICES}) ON starts_with(model, prefix) GROUP BY model",
    ),
    "scan_diff": (
        lambda s, sf: store.scan_changes(_scan(s, sf), _known(s, sf)),
        f"""WITH s AS (SELECT path AS rel, hash, CAST(size AS DOUBLE) AS mtime FROM ({V.FILES})), k AS ({KNOWN})
        SELECT * FROM (SELECT coalesce(s.rel, k.rel) AS rel, CASE WHEN k.rel IS NULL THEN 'A' WHEN s.rel IS NULL THEN 'D' WHEN s.mtime <> k.mtime AND s.hash <> k.hash THEN 'M' END AS status
        FROM s FULL JOIN k ON s.rel = k.rel) WHERE status IS NOT NULL""",
    ),
    "name_status": (
        lambda s, sf: store.name_status(V.values(s, STATUS.format(t="\t"))),
        """SELECT * FROM (VALUES ('new.py', 'A'), ('old.py', 'D'), ('same.py', 'M'), ('a.py', 'D'), ('b.py', 'A'), ('d.py', 'A'), ('link', 'M')) AS t(rel, status)""",
    ),
    "upsert_files": (
        lambda s, sf: store.upsert(_known(s, sf).select("rel", "hash"), _scan(s, sf).where("substring(hash, 1, 1) < '4'").select("rel", "hash"), ["rel"]),
        f"""WITH k AS (SELECT rel, hash FROM ({KNOWN})), n AS (SELECT path AS rel, hash FROM ({V.FILES}) WHERE hash[1:1] < '4') SELECT * FROM k WHERE rel NOT IN (SELECT rel FROM n) UNION ALL SELECT * FROM n""",
    ),
    "cascade_delete": (
        _cascade,
        f"""WITH g AS (SELECT file_id FROM ({V.FILES}) WHERE repo = 'src0'), c AS ({V.CHUNKS}) SELECT count(*) FILTER (file_id NOT IN (SELECT file_id FROM g)) AS chunks,
        count(*) FILTER (file_id NOT IN (SELECT file_id FROM g) AND file_id + 1 NOT IN (SELECT file_id FROM g)) AS edges FROM c""",
    ),
    "orphan_vectors": (
        lambda s, sf: store.orphans(table(s, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), table(s, sf, "labels"), "doc_id"),
        "SELECT vec_id AS doc_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)",
    ),
    "unembedded_docs": (
        lambda s, sf: store.unembedded_files(table(s, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("file_id")), table(s, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"))),
        "SELECT DISTINCT source AS file_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    ),
    "embed_cache_hits": (_cache, f"SELECT md5(content)[1:1] < '8' AS hit, count(*) AS n FROM ({V.CHUNKS}) GROUP BY 1"),
    "chunk_dedupe": (
        lambda s, sf: store.first_of_file(
            V.chunks(s, sf).select("file_id", "chunk_id", "ord", F.lit("code").alias("kind"), F.lit(None).cast("long").alias("symbol_id"), F.md5("content").alias("content_hash"))
        ).select("file_id", "chunk_id", "content_hash"),
        f"SELECT file_id, chunk_id, md5(content) AS content_hash FROM ({V.CHUNKS}) QUALIFY row_number() OVER (PARTITION BY file_id, md5(content) ORDER BY ord) = 1",
    ),
    "line_chunks": (lambda s, sf: V.chunks(s, sf).select("chunk_id", F.md5("content").alias("content_hash")), f"SELECT chunk_id, md5(content) AS content_hash FROM ({V.CHUNKS})"),
    "token_estimate": (
        lambda s, sf: V.chunks(s, sf).select("chunk_id", T.token_estimate(F.col("content")).alias("tokens")),
        f"SELECT chunk_id, CAST(greatest(1, length(content) // 3) AS BIGINT) AS tokens FROM ({V.CHUNKS})",
    ),
    "access_freq": (
        lambda s, sf: store.merge_frequency(
            store.access_frequency(table(s, sf, "events").select("event_type", "user_id")),
            store.access_frequency(table(s, sf, "events").select(F.col("event_type"), (F.col("user_id") % 100).alias("user_id"))),
        ),
        """SELECT event_type, user_id, max(freq) AS freq FROM (SELECT event_type, user_id, count(*) AS freq FROM events GROUP BY ALL
        UNION ALL SELECT event_type, user_id % 100, count(*) FROM events GROUP BY ALL) GROUP BY ALL""",
    ),
    "sql_fingerprint": (
        lambda s, sf: V.values(s, SQLS.replace("''", "\\'")).select("id", F.md5(T.sql_shape(F.col("sql"))).alias("fingerprint")),
        f"""SELECT id, md5(lower(trim(regexp_replace(regexp_replace(regexp_replace(sql, '''[^'']*''', '?', 'g'), '\\b[0-9]+(\\.[0-9]+)?\\b', '0', 'g'), '\\s+', ' ', 'g')))) AS fingerprint FROM ({SQLS})""",
    ),
    "sql_tables": (
        lambda s, sf: V.values(s, SQLS.replace("''", "\\'")).select("id", F.array_join(T.sql_tables(F.col("sql")), ",").alias("tables")),
        """SELECT * FROM (VALUES (1, 't_order,t_user'), (2, 't_item'), (3, ''), (4, 't_a,t_b')) AS t(id, tables)""",
    ),
    "sql_tables_documents": (
        lambda s, sf: table(s, sf, "documents").select("doc_id", F.array_join(T.sql_tables(F.col("text")), ",").alias("tables")),
        r"""SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '\b(?:from|join|into|update)\s+`?(?:[a-z0-9_]+`?\.`?)?([a-z_][a-z0-9_]*)', 1))), ','), '') AS tables FROM documents""",
    ),
    "clean_dynamic": (
        lambda s, sf: V.values(s, DYNAMIC.format()).select("id", T.clean_dynamic(F.col("body")).alias("sql")),
        """SELECT * FROM (VALUES (1, 'SELECT * FROM t WHERE 1=1 AND a = ''?'''), (2, 'UPDATE t SET a = ''?'''), (3, 'b = 1'), (4, 'SELECT 1')) AS t(id, sql)""",
    ),
    "tokenize_query": (
        lambda s, sf: V.values(s, QUESTIONS).select("id", F.array_join(T.query_terms(F.col("q")), ",").alias("terms")),
        """SELECT * FROM (VALUES (1, 'parse,http,request,handle,user,name'), (2, 'user,service,totals,order,repo'), (3, '核保,保规,规则'), (4, ''), (5, 'snake,case,name,12')) AS t(id, terms)""",
    ),
    "identifiers": (
        lambda s, sf: V.values(s, QUESTIONS).select("id", F.array_join(T.identifiers(F.col("q")), ",").alias("names")),
        """SELECT * FROM (VALUES (1, 'user_name'), (2, 'UserService,OrderRepo'), (3, ''), (4, ''), (5, 'snake_case_name')) AS t(id, names)""",
    ),
    "ext_language": (
        lambda s, sf: V.values(s, PATHS).select("path", T.language(F.col("path")).alias("language")),
        """SELECT path, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'java' THEN 'java' WHEN 'py' THEN 'python' WHEN 'tsx' THEN 'tsx' WHEN 'md' THEN 'markdown' WHEN 'go' THEN 'go' END AS language FROM (""" + PATHS + ")",
    ),
    "binary_sniff": (
        lambda s, sf: V.values(s, CONTROL.format(chr=CHAR)).select("id", T.is_binary(F.col("head")).alias("binary")),
        f"""SELECT id, (length(head) - length(regexp_replace(head, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'))) / length(head) > 0.10 AS "binary" FROM ({CONTROL.format(chr=CHAR)})""",
    ),
    "argument_count": (
        lambda s, sf: V.values(s, SIGNATURES).select("id", F.coalesce(T.argument_count(F.col("sig")), F.lit(-1)).alias("argc")),
        "SELECT * FROM (VALUES (1, 0), (2, 2), (3, 3), (4, -1), (5, -1), (6, 0)) AS t(id, argc)",
    ),
    "numbers": (lambda s, sf: V.values(s, CELLS).select("id", T.number(F.col("cell")).alias("n")), f"SELECT id, try_cast(replace(trim(cell), ',', '') AS DOUBLE) AS n FROM ({CELLS})"),
}
