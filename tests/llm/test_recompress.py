import hashlib
import random

import numpy as np
import pytest

from orrery.llm import recompress


def brute(docs, n=20):
    """docs: (doc_id, text), ids unique."""
    first, out = {}, []
    for doc, text in sorted(docs):
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in first:
                gone.update(range(i, i + n))
            else:
                first[tuple(w[i : i + n])] = (doc, i)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, docs=120, few=False):
    r = random.Random(seed)
    vocabulary = ["a", "b"] if few else [f"w{i}" for i in range(60)] + ["é", "日本", " x"]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(15, 60))] for _ in range(6)]
    out = []
    for i in range(docs):
        w = []
        for _ in range(r.randint(0, 5)):
            w += r.choice(passages)[r.randint(0, 8) :] if r.random() < 0.5 else [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
            if r.random() < 0.1:
                w += [r.choice(vocabulary)] * r.randint(2, 70)
        out.append((i * 3 - 5, r.choice([" ", "\n", "\t "]).join(w)))
    return out


@pytest.mark.parametrize(("seed", "few"), [(1, False), (2, False), (3, True)])
def test_equals_brute_force(spark, seed, few):
    docs = corpus(seed, few=few)
    docs += [(5000, docs[7][1]), (5001, docs[7][1]), (5002, " ".join("abcdefghijklmnopqrstuvwxyz"))]
    docs += [(5003, docs[-1][1]), (9001, None), (9002, ""), (9003, "one"), (9004, " \n ")]
    rows = [(d, t, "x", 1) for d, t in docs]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, at int").repartition(5)
    got = sorted(tuple(r) for r in recompress.digests(df).collect())
    assert got == sorted(brute(docs))


def test_equal_windows_have_equal_standing_symbols():
    r = np.random.default_rng(4)
    for few in (3, 50, 10**9):
        passage = r.integers(0, few, 45).astype(np.uint64)
        for _ in range(50):
            texts = [np.concatenate([r.integers(0, few, r.integers(0, 30)).astype(np.uint64), passage, r.integers(0, few, r.integers(0, 30)).astype(np.uint64)]) for _ in range(2)]
            names = []
            for t in texts:
                at = next(i for i in range(len(t)) if (t[i : i + 45] == passage).all())
                name, _, of = recompress.standing(np.append(t, np.uint64(2**63)), np.array([len(t)]))
                names.append(name[of[at : at + 45 - recompress.WINDOW + 1]])
            assert (names[0] == names[1]).all()


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(3, text), (3, text), (7, text), (None, text)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in recompress.digests(df).collect())
    assert got == [(-1, 0), (3, 0), (3, 0), (7, 30)]


def test_rows_of_equal_ids_and_different_texts(spark):
    r = random.Random(1)
    p, q = (" ".join(r.choice("abcdefghijk") + str(r.randrange(50)) for _ in range(26)) for _ in range(2))
    z = "z1 z2 " + q
    df = spark.createDataFrame([(1, p), (5, f"{q} {p}"), (5, z), (5, None), (9, z)], "doc_id long, text string").repartition(2)
    got = {(x.doc_id, x.n_words): x.n_removed for x in recompress.digests(df).collect() if x.doc_id != 9}
    one, other = got.pop((5, 52)), got.pop((5, 28))
    assert (one, other) in ((26, 26), (52, 0)) and got == {(1, 26): 0, (5, 0): 0}  # p is gone, and q once
    assert {x.n_removed for x in recompress.digests(df).collect() if x.doc_id == 9} == {28}


def test_dedup_keeps_columns(spark):
    text = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(1, text, "en", 99), (2, "x  y " + text, "de", 99), (3, text, "fr", 99), (4, "a  b", "es", 99)], "doc_id long, text string, rest string, n_chars long")
    assert sorted(tuple(r) for r in recompress.dedup(df).collect()) == [(1, text, "en", 99), (2, "x y", "de", 3), (4, "a  b", "es", 99)]


def test_empty_table_and_spans(spark):
    assert recompress.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert recompress.spans_of(np.array([5, 3, 3, 25, 46])) == [(3, 45), (46, 66)]
