import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery import agent, cli, config
from orrery.functions import text as T
from orrery.operators import pack, profile, resolve, vectors
from orrery.operators import retrieval as R
from orrery.sources import ingest


def test_settings_and_repositories(tmp_path):
    (tmp_path / "env").write_text("# x\nORRERY_EMBED_DIM=8\nORRERY_HOME='/h'\n")
    s = config.settings({"ORRERY_SIM_THRESHOLD": "0.5", "ORRERY_EMBED_DIM": ""}, f"{tmp_path}/env")
    assert (s.embed_dim, s.sim_threshold, str(s.data), str(s.repos)) == (8, 0.5, "/h/data", "/h/repos.yaml")
    (tmp_path / "r.yaml").write_text("repos:\n- /a/one\n- {path: /b, name: two, exclude: ['*.md']}\n")
    assert config.repositories(tmp_path / "r.yaml") == [{"name": "one", "path": "/a/one", "exclude": []}, {"name": "two", "path": "/b", "exclude": ["*.md"]}]
    assert config.repositories(tmp_path / "none") == []


def test_pack_under_a_budget(spark):
    long = "\n".join(f"line {i:02} of the file" for i in range(1, 41))
    files = spark.createDataFrame([("a.py", "x = 1\ny = 2"), ("b.py", long), ("c.py", "z")], "path string, content string")
    symbols = [("b.py", 1, "class", 1, 30), ("b.py", 2, "function", 3, 5), ("b.py", 3, "function", 4, 6), ("b.py", 4, "function", 35, 36), ("b.py", 9, "module", 1, 40)]
    symbols = spark.createDataFrame(symbols, "path string, id long, kind string, line_start int, line_end int")
    degree = spark.createDataFrame([(2, 5), (3, 4), (4, 1)], "id long, in_degree long")
    pages = spark.createDataFrame([(7, "a.py"), (7, "b.py")], "page_id long, path string")
    (row,) = pack.pack(pages, files, symbols, degree, 90).collect()
    assert row.page_id == 7 and row.tokens <= 90
    text = row.text
    assert "##### FILE: a.py\n" in text and "[lines 1-2]\n    1| x = 1\n    2| y = 2\n" in text
    # the most called is whole; what overlaps it is left out; one caller gives the first line alone
    assert "[lines 3-5]\n    3| line 03" in text and "[lines 4-6]" not in text and "[lines 35-35]\n   35| line 35" in text and "[lines 1-1]" not in text
    assert pack.packed([("c", "z")], [], 0)[0] == "##### FILE: c\n"


def test_links_and_chunks_of_pages(spark):
    assert pack.relative_link("02-b/two.md", "01-a/one.md") == "../02-b/two.md" and pack.relative_link("x.md", "one.md") == "x.md"
    df = spark.createDataFrame([("[a](src/a$1.py:1-2) [b](b.py:3-4)",)], "c string")
    got = df.select(pack.file_links(F.col("c"), "/r", F.array(F.lit("src/a$1.py")))).first()[0]
    assert got == "[a](file:///r/src/a$1.py) [b](b.py:3-4)"
    pages = spark.createDataFrame([("p.md", "Head\n## One\nx\n## Two\n"), ("p.suggested.md", "## no"), ("README.md", "r")], "path string, content string")
    chunks = pack.doc_chunks(pages, "wiki")
    assert {(r.path, r.title, r.line_start) for r in chunks.collect()} == {("p.md", "Head", 1), ("p.md", "One", 2), ("p.md", "Two", 4), ("README.md", "r", 1)}
    assert {r.path for r in pack.human_docs(pages).collect()} == {"p.md", "p.suggested.md"}
    assert pack.replace_kind(chunks, chunks.limit(1), "wiki").count() == 1


def test_embedding_with_a_cache(spark):
    chunks = spark.createDataFrame([("h1", "one two"), ("h1", "one two"), ("h2", "three"), ("h3", "x")], "content_hash string, content string")
    cache = spark.createDataFrame([("h2", "m", [9.0, 9.0]), ("h3", "other", [1.0, 1.0])], "content_hash string, model string, vector array<double>")
    new = vectors.embed(chunks, cache, "m", lambda texts: [[float(len(t)), 0.0] for t in texts], 2, prefix="p ")
    assert sorted((r.content_hash, r.vector) for r in new.collect()) == [("h1", [9.0, 0.0]), ("h3", [3.0, 0.0])]
    assert {(r.content_hash, r.model) for r in vectors.cached(cache, new).collect()} == {("h1", "m"), ("h2", "m"), ("h3", "m"), ("h3", "other")}
    with pytest.raises(Exception, match="not 3 numbers"):
        vectors.embed(chunks, cache, "m", lambda texts: [[0.0, 0.0] for _ in texts], 3).collect()


def test_offline_vectors_and_index(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Alpha beta, alpha"), (2, "alpha BETA alpha"), (3, "gamma"), (4, " ,"), (5, None)], "id long, t string")
    got = {r.id: r.v for r in df.select("id", vectors.hashed(F.col("t"), 32).alias("v")).collect()}
    assert got[1] == got[2] and got[4] is None and got[5] is None and abs(np.linalg.norm(got[3]) - 1) < 1e-9
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(600)]
    table = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    assert vectors.indexed(table) is None
    monkeypatch.setattr(vectors, "LEAST_ROWS", 500)
    index = vectors.indexed(table, lists=8)
    query = rows[5][1]
    exact = [r.chunk_id for r in R.nearest(table, F.array(*map(F.lit, query)), 10).collect()]
    assert [r.chunk_id for r in index.nearest(query, 10, probes=8).collect()] == exact
    assert index.nearest(query, 10, probes=2).first().chunk_id == 5
    gone = vectors.without_files(table, spark.createDataFrame([(1, 7), (2, 8)], "chunk_id long, file_id long"), spark.createDataFrame([(7,)], "file_id long"))
    assert gone.count() == 599 and gone.where("chunk_id = 1").isEmpty()


def test_definitions_profiles_and_slow_queries(spark, tmp_path):
    (tmp_path / "ddl").mkdir()
    (tmp_path / "ddl/depot.sql").write_text("CREATE TABLE old (a int);")
    (tmp_path / "ddl/depot.md").write_text("# d\n```sql\nCREATE TABLE lots (id bigint, state int, PRIMARY KEY (id), KEY by_state (state));\nCREATE TABLE tmp_x (id int);\n```\n")
    (tmp_path / "ddl/yard.sql").write_text("CREATE TABLE carts (id int);")
    d = profile.definitions(profile.ddl_folder(spark, f"{tmp_path}/ddl"))
    assert {(r.schema, r.table) for r in d["tables"].collect()} == {("depot", "lots"), ("depot", "tmp_x"), ("yard", "carts")}
    body = json.loads(profile.template("depot", ["lots", "tmp_x"]))
    assert list(body["tables"]) == ["lots"]
    body["tables"]["lots"] |= {"row_count": 50, "index_cardinality": {"by_state": 3}, "column_stats": {"state": {"cardinality": 3, "null_ratio": 0.5, "top_values": [{"v": "1", "n": 40}, {"v": "2", "n": 5}]}}}
    (tmp_path / "p.json").write_text(json.dumps(body, indent=1))
    out = profile.applied(d["tables"], d["columns"], d["indexes"], profile.profiles(spark, f"{tmp_path}/p.json"))
    assert {(r.table, r.row_count) for r in out["tables"].collect()} == {("lots", 50), ("tmp_x", None), ("carts", None)}
    assert {(r["index"], r.cardinality) for r in out["indexes"].collect()} == {("by_state", 3)}
    assert {(r.column, r.cardinality, r.top_share) for r in out["columns"].where("table = 'lots'").collect()} == {("id", None, None), ("state", 3, 0.8)}
    sheet = profile.sheet(d["tables"])
    assert "## depot" in sheet and "| lots |" in sheet and "tmp_x" not in sheet
    slow = [(None, "SELECT 1 FROM lots", 1.0), ("yard", "SELECT 1 FROM lots", 2.0), (None, "SELECT 1 FROM nothing", 3.0), ("gone", "SELECT 1", 4.0)]
    slow = spark.createDataFrame(slow, "schema string, sql string, freq double")
    own = profile.slow_by_schema(slow, d["tables"])
    assert {(r.schema, r.freq) for r in own.collect()} == {("depot", 1.0), ("yard", 2.0)}
    both, counts = profile.merged_slow(own.limit(1), own)
    assert both.count() == 2 and {r.offered for r in counts.collect()} == {1}
    again = profile.persisted(d["tables"], d["tables"].where("schema = 'yard'").withColumn("row_count", F.lit(1).cast("long")))
    assert again.count() == 3 and again.where("row_count = 1").count() == 1
    found = spark.createDataFrame([("s", "t", "R", "low", "a|b")], "schema string, table string, rule_id string, severity string, evidence string")
    assert [tuple(r) for r in profile.stored_findings(found).collect()] == [("s.t", "R", "low", '{"parts":["a","b"]}')]


def test_tools_and_loop(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("def one():\n    return two()\n\n\ndef two():\n    return 2\n")
    cli.main([f"--store={tmp_path}/out", "index", f"{tmp_path}/src"])
    tools = agent.Tools(spark, f"{tmp_path}/out", f"{tmp_path}/src")
    assert "a.two [a.py:5-6]" in tools.use("definition", {"symbol": "two"})
    assert "a.one" in tools.use("callers", {"symbol": "a.two"}) and "a.two" in tools.use("callees", {"symbol": "one"})
    assert tools.use("impact", {"symbol": "two"}).startswith("1 symbols\n1 a.one")
    assert tools.use("read_file", {"path": "a.py", "start_line": 5, "end_line": 5}) == "    5| def two():"
    assert tools.use("read_file", {"path": "../secret"}) == "no such file" and tools.use("x", {}) == "no such tool: x"
    assert tools.use("definition", {"wrong": 1}).startswith("error:")
    assert "a.py" in tools.use("search", {"query": "where is two"})
    tools.calls.clear()
    text, calls = agent.answer("?", tools, lambda messages, free: {"tool": "definition", "args": {"symbol": "one"}} if free else {"answer": str(len(messages))}, turns=2)
    assert text == "5" and len(calls) == 2


def test_pages_are_tried_again():
    plan = [{"page_id": 1, "title": "A", "files": ["x"]}, {"page_id": 2, "title": "B", "files": ["y"]}]
    got = agent.written_pages(plan, lambda p, k: f"{p['title']}{k}" if p["page_id"] == 1 else 1 / 0, lambda p, t: t.endswith("1"))
    assert got == [{"page": 1, "text": "A1", "tries": 2, "fallback": False}, {"page": 2, "text": "# B\n\n- y\n", "tries": 3, "fallback": True}]


def test_terms_and_deep_paths(spark):
    df = spark.createDataFrame([("Élan vital: NAÏVE straße",)], "t string")
    assert df.select(T.document_terms(F.col("t"))).first()[0] == ["elan", "vital", "naive", "straße"]
    deep = "/".join("abcdefghijkl")
    files = [(f"{deep}/m.ts", "typescript", f"import {{ x }} from '{'../' * 12}x';".encode()), ("x.ts", "typescript", b"export const x = 1;")]
    parses = ingest.parsed(spark.createDataFrame(files, "rel string, language string, content binary"))
    symbols = ingest.symbol_rows(parses)
    names = {r.id: r.file for r in symbols.collect()}
    assert [(names[r.src], names[r.dst]) for r in resolve.import_edges(parses, symbols).collect()] == [(f"{deep}/m.ts", "x.ts")]
