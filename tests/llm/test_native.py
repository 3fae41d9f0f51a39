import hashlib
import re

from orrery.llm import decontaminate, url_filter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for window, own in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_equals_brute_force(spark, tmp_path):
    base = "Alpha beta GAMMA delta épsilon Éta eta theta iota kappa lambda mu nu xi omicron".split()
    items = [(1, " ".join(base[:12])), (2, "short item"), (10, "Only"), (3, None), (4, " ,;"), (5, " ".join(base[:10])), (5, " ".join(base[:10]))]
    docs = [
        (1, "x " * 30 + ", ".join(base) + " y" * 25),
        (2, " ".join(base[:9])),
        (3, None),
        (4, ""),
        (5, "a SHORT item; short item only"),
        (6, " ".join(base).replace("Éta", "éta")),
        (7, "z " * 3000 + " ".join(base[1:11]) + " z" * 3000),
        (7, "z " * 3000 + " ".join(base[1:11]) + " z" * 3000),
        (None, "only"),
    ]
    spark.createDataFrame([(*d, "k", 3) for d in docs], "doc_id long, text string, key string, n long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*d, "k") for d in items], "item_id long, text string, w string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r) for r in decontaminate.op4_decontaminate(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(brute(docs, items), key=str)
    kept = decontaminate.clean(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert kept.columns == ["doc_id", "text", "key", "n"] and {r.doc_id for r in kept.collect()} == {2, 3, 4, 6}


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.decontaminate(docs, none).collect()] == [(1, 2, 0, 0, "", False)]
    assert decontaminate.decontaminate(docs.limit(0), none).count() == 0


def test_url_rules(spark):
    urls = {
        1: ("http://A.Example.COM/en/1?x", "a.example.com", "/en/1", "com/en/", "block"),
        2: ("https://example.com/en/7#t", "example.com", "/en/7", "example.com/en/7", "allow"),
        3: ("https://x.net/de/8", "x.net", "/de/8", "net/de/", "allow"),
        4: ("https://m.example.net/de/81", "m.example.net", "/de/81", "example.net/de/8", "block"),
        5: ("https://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        6: (None, "", "", None, None),
        7: ("no scheme/en/", "", "", None, None),
        8: ("http://org?://b/es/", "org", "", None, None),
        9: ("http://a.org/es/\nb", "a.org", "/es/\nb", "org/es/", "block"),
        10: ("http://example.net/de/7", "example.net", "/de/7", "net/de/", "allow"),
        11: ("http://xexample.net/de/8?q=://", "xexample.net", "/de/8", "net/de/", "allow"),
        12: ("http://net/de/", "net", "/de/", "net/de/", "allow"),
    }
    rows = [(k, v[0], "h", "s") for k, v in urls.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, score string")
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    for k, (_, host, path, rule, verdict) in urls.items():
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == verdict or (verdict is None and got[k].verdict in ("allow", "block"))
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_url_model_separates_its_training_data(spark):
    good = [(i, f"http://good.example.com/en/7{i}") for i in range(40)]
    bad = [(100 + i, f"http://spam.example.org/es/x{i}") for i in range(40)]
    new = [(200, "http://good.example.com/fr/7"), (201, "http://spam.example.org/e")]
    df = spark.createDataFrame(good + bad + new, "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(df).collect()}
    assert got[200] == "allow" and got[201] == "block"
