import math
import random
import re
import zlib
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import html, langid, minhash, quality, toxicity

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.op2_language_id(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == len(truth)


def test_language_of_odd_texts(spark):
    rows = [(1, "the cat and the dog", "en"), (3, "der Hund und die Katze", "de"), (5, None, "en"), (6, "", None), (7, "123 !!", "de"), (8, "日本語", None), (None, "and the", "en")] + [(100 + i, "der und die " * 9, "de") for i in range(20)] + [(200 + i, "the and of " * 9, "en") for i in range(20)]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, score string, held_out double")
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(df, langid.train(df)).collect()]
    assert {x for d, x in got if d in (5, 6, 7)} == {"und"} and (1, "en") in got and (3, "de") in got and (None, "en") in got
    assert {r.doc_id for r in langid.known(df, langid.train(df)).collect()} == {r[0] for r in rows} - {5, 6, 7}
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.predict(none, langid.train(none)).collect()] == [(1, "und", 0.0)]


def test_kernel_is_the_blended_spectrum():
    rows = [("abab", "x"), ("abba", "x"), ("cdcd", "y"), ("dccd", "y")]
    model = langid.fit(rows)
    own = lambda t: {t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}
    texts = ["abab", "abba", "xyz ab"]  # of the last, most n-grams are in no landmark: they count in its norm all the same
    (_, p, sizes), *_ = model.presence([langid.grams(t) for t in texts])
    assert sizes.tolist() == [len(own(f" {t} ")) for t in texts]
    for i, a in enumerate(texts[:2]):
        for j, b in enumerate(texts):
            common = len(own(f" {a} ") & own(f" {b} "))
            assert abs(p[i] @ p[j] / math.sqrt(sizes[i] * sizes[j]) - common / math.sqrt(len(own(f" {a} ")) * len(own(f" {b} ")))) < 1e-6


def test_language_scores_equal_kernel_ridge(spark):
    """The folded matrix against kernel ridge regression with all pairs of texts in the kernel, all rows landmarks."""
    rows = [("the cat and the dog", "en"), ("the house of the man", "en"), ("der Hund und das Haus", "de"), ("die Katze und der Mann", "de"), ("el perro y la casa", "es"), ("la casa del hombre", "es")]
    new = ["the dog of the house", "und die Frau", "y el hombre", "q", "Der " * 3000 + "x"]
    own = lambda t: {x.tobytes() for n, g in enumerate(langid.grams(t)) for x in np.unique(g)} if t else set()
    kernel = lambda a, b: len(own(a) & own(b)) / math.sqrt(len(own(a)) * len(own(b)))
    rows = sorted(rows)
    languages = sorted({lang for _, lang in rows})
    k = np.array([[kernel(a, b) for b, _ in rows] for a, _ in rows])
    y = np.array([[1.0 if lang == x else -1.0 for x in languages] for _, lang in rows])
    alpha = np.linalg.solve(k.T @ k + langid.RIDGE * len(rows) * k + 1e-8 * np.eye(len(rows)), k.T @ y)
    want = np.array([[kernel(t, b) for b, _ in rows] for t in new]) @ alpha
    labels, _ = langid.fit(rows, landmarks=6).scores(new)
    assert labels == [languages[i] for i in want.argmax(1)]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.predict(empty, langid.fit(rows)).count() == 0


def test_toxicity_of_held_out_documents(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [r for r in toxicity.op9_toxicity(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    hits = sum(r.predicted and labels[r.doc_id] for r in rows)
    assert hits >= 0.85 * sum(labels[r.doc_id] for r in rows) and hits >= 0.85 * sum(r.predicted for r in rows)


def test_grammar():
    lexicon = toxicity.Lexicon({}, {})
    value = lambda text: toxicity.features(text, lexicon)[:-1].nonzero()[0].tolist()
    assert value("what a moron") == [0] and value("you moron") == [4] and value("moron, you") == [0]
    assert value("not a moron") == [2] and value("she said moron") == [5] and value("i will kill you") == [28]
    assert value("all fine here") == [] and value(None) == []
    # phrases of several words: the same words without the phrase are nothing, or a weaker class
    assert value("what a waste of space") == [16] and value("lots of space") == [] and value("you piece of trash") == [20]
    assert value("kill you") == [12] and value("they want to really hurt him") == [28] and value("it will be long until paint can hurt") == [8]
    assert value("never a piece of garbage") == [18] and value("a piece of garbage, you") == [16]


def test_composition_equals_its_parts():
    """The product table against the five transducers, each run alone."""
    r = random.Random(2)
    for _ in range(300):
        states, state = [0] * len(toxicity.PARTS), 0
        for _ in range(12):
            s = r.randrange(toxicity.SYMBOLS)
            said = 0
            for k, (_, step, say) in enumerate(toxicity.PARTS):
                said |= say(states[k], s)
                states[k] = step(states[k], s)
            assert toxicity.SAID[state][s] == said
            state = toxicity.NEXT[state][s]


def test_toxicity_of_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "you idiot", 5), (2, "word " * 40_000 + "you moron", 6)], "doc_id long, text string, key long")
    labels = spark.createDataFrame([(1, 1, "t", 3)], "doc_id long, toxic int, text string, y long")
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert {r.doc_id for r in toxicity.score(docs, model).collect()} == {1, 2} and toxicity.train(docs.limit(0), labels).words == {}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "you idiot, you moron", "s"), (2, None, "s"), (2, "", "s")], "doc_id long, text string, score string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = [(r.doc_id, r.score >= 0.5) for r in toxicity.score(docs, model).collect()]
    assert got == [(1, True), (2, False), (2, False)]


def test_quality_of_held_out_documents(spark):
    """A fifth of the labels is kept from training; the rest of the corpus is unlabelled."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    got = quality.quality(docs, labels.where(~F.col("doc_id").isin(list(held)))).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    rows = [r for r in got if r.doc_id in held]
    assert len(rows) > 50 and sum(r.kept == bool(truth[r.doc_id]) for r in rows) >= 0.95 * len(rows)


def test_quality_sums_over_all_documents(spark):
    """Histograms and gradients against the same over all rows at once."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["Good", "text.", "XX", "yy!!", "zz"], rng.integers(0, 30))), f"s{i % 3}", "en", int(rng.integers(0, 900))) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(4)
    corpus = quality.features(df, "doc_id", "text")
    words = quality.Words()
    t = np.array([quality.text_view(r[1], words) for r in rows]).astype(np.float16).astype(float)
    m = np.array([quality.metadata_view(*r[2:]) for r in rows]).astype(np.float16).astype(float)
    views = [rng.normal(size=x.shape[1] + 1) for x in (t, m)]
    counts = quality.summed(corpus, 2 * quality.BINS, quality.histogram(views))
    assert counts.sum() == 180 and (counts == quality.histogram(views)((t, m))).all()
    cuts = [quality.limits(c, 0.4, 0.5) for c in counts.reshape(2, -1)]
    assert all(lo <= -quality.SURE and hi >= quality.SURE for lo, hi in cuts)
    cuts = [(-0.5, 0.5)] * 2
    assert np.allclose(quality.summed(corpus, sum(len(w) + 1 for w in views), quality.gradients(views, cuts)), quality.gradients(views, cuts)((t, m)))


def test_quality_of_odd_tables(spark):
    rows = [(1, None, None, None, None, 1), (2, "a b", "s", "en", 3, 1), (2, "a b", "s", "en", 3, 1), (3, "word " * 60_000, "s", "en", 3, 1), (None, "", "s", "en", 3, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, score int")
    labels = spark.createDataFrame([(2, None, "x"), (1, 1, "x")], "doc_id long, quality int, t string")
    got = [(r.doc_id, r.score, r.kept) for r in quality.quality(docs, labels).collect()]
    assert sorted(got, key=str) == sorted([(d, 0.5, True) for d, *_ in rows], key=str)
    assert quality.quality(docs.limit(0), labels).count() == 0
    both = spark.createDataFrame([(3, 0, "x"), (1, 1, "x")], "doc_id long, quality int, t string")
    assert quality.quality(docs, both).count() == 5


def article(page):
    """What the test pages' own marks say."""
    inner = (re.search(r"<article>(.*?)(?:</article>|<footer|$)", page, re.S) or ["", ""])[1]
    blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*(>|$)", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1|h2)>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = html.op7_extract(spark, SF).collect()
    assert len(rows) == len(pages) and all(r.text == article(pages[r.page_id]) and r.n_chars == len(r.text) for r in rows)


@pytest.fixture(scope="module")
def trees():
    return html.train([])


def test_shapes_without_section_tags(trees):
    """Generated pages that training hasn't seen, with and without section tags, against what the generator wrote."""
    good, words, wrong = 0, 0, 0
    for i in range(1000, 1060):
        page = html.generated(i)
        order = html.measure(html.parse(page))
        want = html.blocks(order, [True] + [y != 0 and n.tag not in html.NEVER for n, y in zip(order[1:], html.marked(order)[1:], strict=True)])
        page = re.sub(r" data-truth='.'", "", page)
        if i % 2:
            page = re.sub(r"<(/?)(article|main|nav|header|footer|aside|section)\b", r"<\1div", page)
        got = html.extract(page, trees)
        good += got == want
        words += len(want.split())
        wrong += abs(len(got.split()) - len(want.split()))
    assert good >= 48 and wrong <= 0.03 * words


def test_attributes_and_siblings_are_features(trees):
    rows = []
    for name in ("advert", "story"):
        order = html.measure(html.parse(f"<body><div class='{name}'>one two</div><p>x <a>y</a></p></body>"))
        rows.append(html.features(order, trees.tokens))
    assert (rows[0][2] != rows[1][2]).any()
    one, two = (html.features(html.measure(html.parse(f"<body><p>a b c</p><p>{more}</p></body>")), trees.tokens)[2] for more in ("<a>menu</a>", "words and words"))
    assert (one != two).any()


def test_nothing_of_an_article_is_dropped(trees):
    body = "This is the text of a page, with some words. " * 6
    page = f"<article><h1>Head</h1><p>{body}</p><p>Euler: <math>e=mc2</math> ok</p><p>Use <label>this</label> <span hidden>now</span> here</p><svg><text>Fig 1</text></svg><p>{body}</p></article>"
    assert html.extract(page, trees) == f"Head\n\n{body.strip()}\n\nEuler: e=mc2 ok\n\nUse this now here\n\nFig 1\n\n{body.strip()}"


def test_empty_table_and_deep_pages(spark, trees):
    assert html.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    deep = "<div>" * 3000 + "word " * 200 + "</div>" * 3000
    assert html.extract(f"<article>{deep}</article>", trees).split() == ["word"] * 200
    long = "<p>" + "Some words of a text, and more. " * 20 + "</p>"
    assert html.extract(f"<nav><a>x</a></nav><article>{long * 600}</article>", trees).count("\n\n") == 599


def test_odd_pages(spark, trees):
    assert html.extract(None, trees) == html.extract("", trees) == html.extract("<nav><a href=x>y</a></nav>", trees) == ""
    body = "This is the text of a page, with some words. " * 5
    page = f"<html><body><nav><ul><li><a href='/'>home</a></ul></nav><article><h1>A &lt; B</h1><p>{body}<p>two&nbsp;&amp;\n three <b>bold</b></article><footer>foot"
    assert html.extract(page, trees) == f"A < B\n\n{body.strip()}\n\ntwo & three bold"
    df = spark.createDataFrame([(1, None, None, "t"), (1, "u", page, "t")], "page_id long, url string, html string, text string")
    assert [(r.page_id, r.url, r.n_chars > 0) for r in html.extracted(df, trees=trees).collect()] == [(1, None, False), (1, "u", True)]


def near(docs, size=3, threshold=85):
    sets = {}
    for d, t in docs:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        n = min(size, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in sets)


def test_near_duplicates_equal_brute_force(spark):
    import random

    r = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    docs, k = [], 0
    for _ in range(6):
        base = [r.choice(words) for _ in range(r.randint(60, 90))]
        for _ in range(r.randint(1, 25)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(words)
            docs.append((k := k + r.randint(1, 3), " ".join(w)))
    docs += [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "one two"), (905, "é É"), (906, "é é")]
    r.shuffle(docs)
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, kept string, n long").repartition(3)
    assert sorted(tuple(x) for x in minhash.grouped(df).collect()) == near(docs)
    kept = {x.doc_id for x in minhash.one_of_each(df).collect()}
    assert kept == {d for d, _, _, own in near(docs) if own}


def test_near_duplicates_of_nothing(spark):
    assert minhash.grouped(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (2, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.component_id or 0, x.kept) for x in minhash.grouped(df).collect()) == [(0, 0, True), (2, 2, True), (2, 2, True)]
