import subprocess

import pytest
from pyspark.sql import functions as F

from orrery.operators import graph, resolve
from orrery.sources import ingest
from orrery.sources.parsers import parse

FILES = {
    "shop/model/User.java": "package shop.model;\n\n/** A user. */\npublic class User {\n    private String name;\n    public String getName() { return name; }\n}\n",
    "shop/core/UserService.java": """package shop.core;

import shop.model.User;
import static shop.util.Strings.trimmed;

public class UserService {
    private final User owner;
    public boolean validate(User user) {
        String n = trimmed(user.getName(), 2);
        Helper h = new Helper(1);
        h.run();
        missing(n);
        return check(n) && check(n, 1);
    }
    @Deprecated
    boolean check(String s) { return true; }
    boolean check(String s, int k) { return false; }
}
class Helper { Helper(int n) { } void run() { } }
""",
    "shop/util/Strings.java": "package shop.util;\npublic class Strings { public static String trimmed(String s, int n) { return s; } }\n",
    "web/src/util.ts": "export function total(n: number) { return n; }\nexport const twice = (n: number) => { return total(n) + total(n); };\n",
    "web/src/order.ts": "import { total as sum } from './util';\nexport class Order {\n  save(id: number) { return sum(id); }\n}\nexport function make() { return new Order(); }\n",
    "lib/a.py": "from .b import helper as h\nimport lib.b as other\n\ndef run(x):\n    h(x)\n    other.second(x, 1)\n    return unique_elsewhere()\n",
    "lib/b.py": "def helper(x):\n    return x\n\ndef second(a, b):\n    return helper(a)\n",
    "lib/__init__.py": "",
    "lib/c.py": "def unique_elsewhere():\n    return 1\n",
    "notes.md": "Intro\n\n## One\ntext\n```\n## code\n```\n## Two\nmore\n",
    "target/out.java": "class Out {}",
    "sub/.gitignore": "*.log\n!keep.log\n",
    "sub/x.log": "x",
    "sub/keep.log": "x",
    ".gitignore": "target/\n# note\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for rel, text in FILES.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_text(text)
    return str(root)


def test_scan_honours_ignore_files(spark, tree):
    got = {r.rel for r in ingest.scan(spark, tree, ["lib/c.py"]).select("rel").collect()}
    assert got == set(FILES) - {"target/out.java", "sub/.gitignore", ".gitignore", "sub/x.log", "lib/c.py"}


def names(spark, tree):
    parses = ingest.parsed(ingest.readable(ingest.scan(spark, tree))).cache()
    symbols = ingest.symbol_rows(parses).cache()
    return parses, symbols, {r.id: r.qname for r in symbols.collect()}


def test_imports_and_calls(spark, tree):
    parses, symbols, name = names(spark, tree)
    imports = resolve.import_edges(parses, symbols).cache()
    got = {(name[r.src], name[r.dst]) for r in imports.collect()}
    assert got == {
        ("shop/core/UserService.java", "shop/model/User.java"),
        ("shop/core/UserService.java", "shop/util/Strings.java"),
        ("web/src/order.ts", "web/src/util.ts"),
        ("lib/a.py", "lib/b.py"),
    }
    calls = {(name[r.src], name[r.dst], r.resolution) for r in resolve.call_edges(parses, symbols, imports).collect()}
    service = "shop.core.UserService#validate"
    assert calls == {
        (service, "shop.util.Strings#trimmed", "exact"),
        (service, "shop.model.User#getName", "exact"),
        (service, "shop.core.Helper#Helper", "exact"),
        (service, "shop.core.Helper#run", "exact"),
        (service, "shop.core.UserService#check", "exact"),
        (service, "shop.core.UserService#check@17", "exact"),
        ("web/src/util.twice", "web/src/util.total", "exact"),
        ("web/src/order.Order#save", "web/src/util.total", "exact"),
        ("web/src/order.make", "web/src/order.Order", "exact"),
        ("lib.a.run", "lib.b.helper", "exact"),
        ("lib.a.run", "lib.b.second", "exact"),
        ("lib.a.run", "lib.c.unique_elsewhere", "heuristic"),
        ("lib.b.second", "lib.b.helper", "exact"),
    }


def test_contains_and_impact(spark, tree):
    parses, symbols, name = names(spark, tree)
    got = {(name[r.src], name[r.dst]) for r in ingest.contains_edges(symbols).collect()}
    assert ("shop.model.User", "shop.model.User#getName") in got and ("lib/b.py", "lib.b.helper") in got
    calls = resolve.call_edges(parses, symbols, resolve.import_edges(parses, symbols))
    seed = symbols.where("qname = 'lib.b.helper'").select(F.col("id").alias("node"))
    assert {(name[r.node], r.depth) for r in graph.impact(calls, seed).collect()} == {("lib.a.run", 1), ("lib.b.second", 1)}


def test_chunks(spark, tree):
    files = ingest.readable(ingest.scan(spark, tree))
    got = {(r.file, r.title): (r.line_start, r.line_end) for r in ingest.chunked(files).collect()}
    assert got["shop/model/User.java", "shop.model.User"] == (3, 5)
    assert got["shop/model/User.java", "shop.model.User#getName"] == (6, 6)
    assert (got["notes.md", "Intro"], got["notes.md", "One"], got["notes.md", "Two"]) == ((1, 2), (3, 7), (8, 10))


def test_word_chunks_lose_nothing():
    text = "\n".join(" ".join(f"word{i * j}" for j in range(9)) for i in range(40)) + "\n" + "x" * 500
    got = ingest.word_chunks(text, 40)
    assert " ".join(c["content"] for c in got).split() == text.split()
    assert all(len(c["content"]) // 3 <= 40 or " " not in c["content"] for c in got)
    assert got[0]["line_start"] == 1 and got[-1]["line_end"] == 41
    assert ingest.word_chunks(" \n ", 5) == []


def test_unreadable_files():
    assert parse("x.py", "python", b"def (")["status"] == "failed"
    assert [s["kind"] for s in parse("x.py", "python", b"def (")["symbols"]] == ["module"]
    assert parse("q.sql", "sql", b"select")["status"] == "ok"
    for lang in ("java", "typescript", "go"):
        assert parse("x", lang, b"class { ( } ] func type")["status"] in ("ok", "failed")


def test_change_set(tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", "-C", str(tmp_path), *a], check=True, capture_output=True, text=True)
    assert ingest.change_set(str(tmp_path), None) is None
    run("init", "-q")
    for n in "abc":
        (tmp_path / f"{n}.py").write_text(n * 50)
    run("add", "."), run("commit", "-qm", "one")
    base = run("rev-parse", "HEAD").stdout.strip()
    assert ingest.change_set(str(tmp_path), None) == [("a.py", "A"), ("b.py", "A"), ("c.py", "A")]
    (tmp_path / "a.py").write_text("changed")
    (tmp_path / "b.py").unlink()
    (tmp_path / "c.py").rename(tmp_path / "d.py")
    assert ingest.change_set(str(tmp_path), base) is None  # not committed
    run("add", "-A"), run("commit", "-qm", "two")
    assert sorted(ingest.change_set(str(tmp_path), base)) == [("a.py", "M"), ("b.py", "D"), ("c.py", "D"), ("d.py", "A")]
    assert ingest.change_set(str(tmp_path), "0" * 40) is None
