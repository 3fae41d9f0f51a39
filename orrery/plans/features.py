"""Queries of parsing, resolution, stored postings, page planning and profiles over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.operators import graph, pack, postings, profile, resolve, vectors
from orrery.plans import searches as S
from orrery.plans import views as V
from orrery.session import shared_dir, table, written
from orrery.sources import ingest

MODULES = 96
#: language, path, head, function, last line, and what the test needs to know of them. {k}: the file, {n}: another of its language.
SHAPES = [
    ("python", "m{k}.py", "import m{n}\n\n", "def f_{p}():\n    return {c}\n\n", ""),
    ("java", "src/A{k}.java", "package src;\n\npublic class A{k} {\n", "    int f_{p}() {\n        return {c};\n    }\n", "}\n"),
    ("typescript", "m{k}.ts", "import { x } from './m{n}';\n", "export function f_{p}() {\n  return {c};\n}\n", ""),
    ("go", "m{k}.go", "package m\n\n", "func f_{p}() int {\n\treturn {c}\n}\n", ""),
]


def sources(s, sf):
    """rel, language, content: a source file for each MODULES-th part, with a function for each part, which calls the next. The
    count of partitions is fixed: keys are small and what is parsed from them isn't, so that they would be put into one task."""
    one = table(s, sf, "part").where(F.col("p_partkey").isNotNull()).select("p_partkey", (F.col("p_partkey") % MODULES).alias("k"))
    one = one.repartition(MODULES, "k").groupBy("k").agg(F.array_sort(F.collect_list("p_partkey")).alias("ps")).withColumn("n", (F.col("k") + 4) % MODULES)

    def fill(shape: str, **what):
        out = F.lit(shape)
        for name, value in what.items():
            out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
        return out

    def one_function(shape: str):
        call = lambda j: F.coalesce(F.concat(F.lit("f_"), F.get("ps", j + 1).cast("string"), F.lit("()")), F.lit("1"))
        return lambda p, j: fill(shape, p=p, c=call(j))

    rel = language = content = None
    for i, (lang, path, head, function, last) in enumerate(SHAPES):
        body = F.array_join(F.transform("ps", one_function(function)), "")
        own = (fill(path, k=F.col("k")), F.lit(lang), F.concat(fill(head, k=F.col("k"), n=F.col("n")), body, F.lit(last)))
        mine = F.col("k") % 4 == i
        rel, language, content = ((F.when(mine, new) if old is None else old.when(mine, new)) for old, new in zip((rel, language, content), own, strict=True))
    return one.select(rel.alias("rel"), language.alias("language"), content.cast("binary").alias("content"))


def _parsed(s, sf):
    parses = written(ingest.parsed(sources(s, sf)), "parses")
    return parses, written(ingest.symbol_rows(parses), "symbols")


SOURCES = f"""f AS (SELECT p_partkey AS p, p_partkey % {MODULES} AS k, (p_partkey % {MODULES} + 4) % {MODULES} AS n, row_number() OVER w - 1 AS i, lead(p_partkey) OVER w AS c,
  count(*) OVER (PARTITION BY p_partkey % {MODULES}) AS size FROM part WINDOW w AS (PARTITION BY p_partkey % {MODULES} ORDER BY p_partkey)),
  named AS (SELECT *, CASE k % 4 WHEN 0 THEN 'm' || k || '.py' WHEN 1 THEN 'src/A' || k || '.java' WHEN 2 THEN 'm' || k || '.ts' ELSE 'm' || k || '.go' END AS file,
  CASE k % 4 WHEN 1 THEN 'src.A' || k || '#f_' ELSE 'm' || k || '.f_' END AS before, CASE k % 4 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 3 END + 3 * i AS a,
  CASE k % 4 WHEN 0 THEN 1 ELSE 2 END AS more FROM f)"""


def _calls(s, sf):
    parses, symbols = _parsed(s, sf)
    out = resolve.call_edges(parses, symbols, resolve.import_edges(parses, symbols))
    names = symbols.select("id", "qname")
    out = out.join(names.withColumnsRenamed({"id": "src", "qname": "caller"}), "src").join(names.withColumnsRenamed({"id": "dst", "qname": "callee"}), "dst")
    return out.select("caller", "callee", "resolution")


def _imports(s, sf):
    parses, symbols = _parsed(s, sf)
    names = symbols.where("idx = 0").select("id", "file")
    out = resolve.import_edges(parses, symbols)
    return out.join(names.withColumnsRenamed({"id": "src", "file": "src_file"}), "src").join(names.withColumnsRenamed({"id": "dst", "file": "dst_file"}), "dst").select("src_file", "dst_file")


def _contains(s, sf):
    _, symbols = _parsed(s, sf)
    n = ingest.contains_edges(symbols).groupBy("src").agg(F.count("*").alias("members"))
    return n.join(symbols.select(F.col("id").alias("src"), "qname"), "src").select("qname", "members")


def _stored(s, sf):
    path = f"{shared_dir(s)}/postings-{uuid.uuid4().hex}"
    postings.write(V.chunks(s, sf), path)
    return postings.read(s, path)


def _replaced(s, sf):
    """The index after the documents of every seventh id went and those of every eleventh changed to another text."""
    chunks = V.chunks(s, sf)
    gone = chunks.where("file_id % 7 = 0 OR file_id % 11 = 0")
    new = chunks.where("file_id % 11 = 0 AND file_id % 7 <> 0").withColumn("content", F.lit("que que thing"))
    return postings.bm25(postings.replaced(postings.build(chunks), gone, new), S.TERMS, None)


CHANGED = f"""SELECT chunk_id, file_id, CASE WHEN file_id % 11 = 0 THEN 'que que thing' ELSE content END AS content FROM ({V.CHUNKS}) WHERE file_id % 7 <> 0"""


def _files(s, sf):
    suffix = F.element_at(F.array(*map(F.lit, (".java", ".py", ".ts", ".xml", ".md"))), (F.col("doc_id") % 5 + 1).cast("int"))
    d = table(s, sf, "documents")
    return d.select(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), suffix).alias("path"), F.when(F.col("n_chars") > 200, "ok").otherwise("failed").alias("status"), "source", F.col("text").alias("content"))


FILES = "SELECT 'src/' || doc_id || ['.java', '.py', '.ts', '.xml', '.md'][doc_id % 5 + 1] AS path, CASE WHEN n_chars > 200 THEN 'ok' ELSE 'failed' END AS status, source FROM documents"


def _ranked_symbols(s, sf):
    degree = graph.in_degree(V.edges(s, sf))
    return pack.by_in_degree(V.symbols(s, sf).select("id", "file_id"), degree).select("id", "file_id", "in_degree", "rank")


def _plan(s, sf):
    """A page for each conversation, of files named by the lengths of its texts."""
    t = table(s, sf, "conversations").where(F.col("conv_id").isNotNull() & F.col("text").isNotNull())
    name = F.concat(F.lit("f"), (F.length("text") % 50).cast("string"))
    pages = t.groupBy(F.col("conv_id").alias("page_id")).agg(F.array_sort(F.collect_set(name)).alias("files"))
    known = s.range(50).where("id % 3 = 0").select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"))
    return pack.planned(pages, known).select("page_id", F.array_join("files", ",").alias("files"))


def _links(s, sf):
    known = F.array(*(F.lit(f"src/{i}.py") for i in range(0, 51, 2)))
    body = F.concat(F.lit("see [it](src/"), F.col("p_size").cast("string"), F.lit(".py:1-"), F.col("p_partkey").cast("string"), F.lit(") and (no:1-2)"))
    return table(s, sf, "part").select("p_partkey", pack.file_links(body, "/r", known).alias("content"))


def _refs(s, sf):
    d = table(s, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.md5("text").alias("content_hash"))
    held = table(s, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")).join(d, "chunk_id")
    cache = held.groupBy("content_hash").agg(F.min_by("vector", "chunk_id").alias("vector")).withColumn("model", F.lit("m"))
    return vectors.rebuild_counts(vectors.rebuilt(d.select("chunk_id", F.lit("m").alias("model")), d, cache))


def _stats(s, sf):
    out = None
    for name, columns in (("lineitem", ["l_returnflag", "l_linenumber"]), ("customer", ["c_mktsegment", "c_nationkey"])):
        one = profile.column_stats(table(s, sf, name).select(*columns), columns, 3)
        out = one if out is None else out.unionByName(one)
    tops = F.array_join(F.transform("top_values", lambda v: F.concat_ws("=", v["v"], v["n"].cast("string"))), ",")
    return out.select("column", "cardinality", "null_ratio", tops.alias("top_values"))


def _stat_sql(t: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM {t}) AS cardinality, (SELECT round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM {t}) AS null_ratio,
      (SELECT string_agg(v || '=' || n, ',' ORDER BY n DESC, v) FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 3)) AS top_values"""


def _signature():
    nested = F.when(F.col("p_partkey") % 3 == 0, F.lit("Map<K, List<V>> m[a, b]")).otherwise(F.lit("g((((((((a, b)))))))), c"))
    return F.concat(F.lit("f("), F.repeat(F.lit("x, "), (F.col("p_size") % 5).cast("int")), nested, F.when(F.col("p_partkey") % 7 == 0, F.lit("(")).otherwise(F.lit("")), F.lit(")"))


CATALOG = {
    "parse_symbols": (
        lambda s, sf: _parsed(s, sf)[1].where("kind <> 'module'").select("file", "qname", "kind", "line_start", "line_end"),
        f"""WITH {SOURCES} SELECT file, before || p AS qname, CASE WHEN k % 4 = 1 THEN 'method' ELSE 'function' END AS kind, a AS line_start, a + more AS line_end FROM named
        UNION ALL SELECT file, 'src.A' || k, 'class', 3, max(size) * 3 + 4 FROM named WHERE k % 4 = 1 GROUP BY file, k""",
    ),
    "resolve_calls": (_calls, f"WITH {SOURCES} SELECT before || p AS caller, before || c AS callee, 'exact' AS resolution FROM named WHERE c IS NOT NULL"),
    "resolve_imports": (_imports, f"WITH {SOURCES} SELECT DISTINCT a.file AS src_file, b.file AS dst_file FROM named a JOIN named b ON b.k = a.n WHERE a.k % 4 IN (0, 2)"),
    "contains": (_contains, f"WITH {SOURCES} SELECT CASE WHEN k % 4 = 1 THEN 'src.A' || k ELSE file END AS qname, count(*) AS members FROM named GROUP BY 1 UNION ALL SELECT DISTINCT file, 1 FROM named WHERE k % 4 = 1"),
    "bm25_stored": (lambda s, sf: postings.bm25(_stored(s, sf), S.TERMS, None), f"WITH {S._c(V.CHUNKS)} {S._bm25_sql('', None)}"),
    "bm25_in_repo": (
        lambda s, sf: postings.bm25(_stored(s, sf), S.TERMS, None, V.chunks(s, sf).join(V.files(s, sf).where("repo = 'src3'"), "file_id", "left_semi")),
        f"WITH {S._c(V.CHUNKS)} SELECT b.* FROM ({S._bm25_sql('', None)}) b JOIN ({V.FILES}) f ON f.file_id = b.chunk_id // 100000 WHERE repo = 'src3'",
    ),
    "bm25_after_changes": (_replaced, f"WITH {S._c(CHANGED)} {S._bm25_sql('', None)}"),
    "code_files": (lambda s, sf: pack.code_files(_files(s, sf)).select("path"), f"SELECT path FROM ({FILES}) WHERE status = 'ok' AND (path LIKE '%.java' OR path LIKE '%.ts' OR path LIKE '%.tsx' OR path LIKE '%.xml' OR path LIKE '%.js')"),
    "named_symbols": (
        lambda s, sf: pack.named(table(s, sf, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.concat(F.lit("__"), "p_name")).otherwise(F.concat(F.lit("_"), "p_name")).alias("name"))),
        "SELECT p_partkey, '_' || p_name AS name FROM part WHERE p_size <= 25",
    ),
    "symbols_by_in_degree": (
        _ranked_symbols,
        f"""SELECT id, file_id, in_degree, row_number() OVER (PARTITION BY file_id ORDER BY in_degree DESC, id) AS rank FROM
        (SELECT s.id, file_id, coalesce(d.n, 0) AS in_degree FROM ({V.SYMBOLS}) s LEFT JOIN (SELECT dst, count(*) AS n FROM ({V.EDGES}) GROUP BY dst) d ON d.dst = s.id)""",
    ),
    "worth_planning": (
        lambda s, sf: pack.worth_planning(graph.clusters(V.files(s, sf)), 30),
        f"SELECT repo AS module, count(*) AS files FROM ({V.FILES}) GROUP BY 1 HAVING count(*) >= 30",
    ),
    "planned_pages": (
        _plan,
        """SELECT conv_id AS page_id, string_agg(f, ',' ORDER BY f) AS files FROM (SELECT DISTINCT conv_id, 'f' || (length(text) % 50) AS f FROM conversations WHERE text IS NOT NULL AND (length(text) % 50) % 3 = 0) GROUP BY conv_id""",
    ),
    "file_links": (
        _links,
        "SELECT p_partkey, 'see [it](' || CASE WHEN p_size % 2 = 0 THEN 'file:///r/src/' || p_size || '.py' ELSE 'src/' || p_size || '.py:1-' || p_partkey END || ') and (no:1-2)' AS content FROM part",
    ),
    "rebuild_vectors": (
        _refs,
        """WITH d AS (SELECT doc_id, md5(text) AS h FROM documents), c AS (SELECT DISTINCT h FROM d JOIN embeddings ON vec_id = doc_id WHERE embedding IS NOT NULL)
        SELECT count(c.h) AS rebuilt, count(*) FILTER (c.h IS NULL) AS missing FROM d LEFT JOIN c USING (h)""",
    ),
    "column_stats": (_stats, " UNION ALL ".join(_stat_sql(t, c) for t, c in (("lineitem", "l_returnflag"), ("lineitem", "l_linenumber"), ("customer", "c_mktsegment"), ("customer", "c_nationkey")))),
    "base_types": (
        lambda s, sf: table(s, sf, "part").select("p_partkey", T.base_type(F.concat("p_type", F.lit("("), F.col("p_size").cast("string"), F.lit(")"))).alias("kind")),
        "SELECT p_partkey, upper(trim(p_type)) AS kind FROM part",
    ),
    "signature_counts": (
        lambda s, sf: table(s, sf, "part").select("p_partkey", F.coalesce(T.argument_count(_signature()), F.lit(-1)).alias("n")),
        "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN -1 ELSE CAST(p_size % 5 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) END AS n FROM part",
    ),
}
