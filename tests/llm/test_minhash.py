import random

from orrery.llm import minhash


def brute(docs, size, threshold):
    sets = {d: {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for d, w in docs}
    root = {d: d for d in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in sets}


def test_rules_of_other_size_and_threshold(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    docs = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(120)]
        docs.append(base)
        docs += [base + [r.choice(words) for _ in range(n)] for n in (20, 25, 28, 33)]
        docs.append([r.choice(words) if r.random() < 0.03 else w for w in base])
    docs = list(enumerate(docs, 1))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string").repartition(3)
    found = {}
    for rule in (minhash.OP6, minhash.FIVE_WORDS):
        found[rule] = {x.doc_id: x.component_id for x in minhash.grouped(df, rule=rule).collect()}
        assert found[rule] == brute(docs, rule.size, rule.threshold)
        assert {x.doc_id for x in minhash.one_of_each(df, rule=rule).collect()} == set(found[rule].values())
    assert found[minhash.OP6] != found[minhash.FIVE_WORDS]


def test_a_group_below_the_threshold_in_many_parts(spark, monkeypatch):
    """Edits of one text, of which few reach the threshold with it: links among the others are found across parts."""
    monkeypatch.setattr(minhash, "PART_ROWS", 16)
    r = random.Random(8)
    base = [f"b{i}" for i in range(100)]
    docs = []
    for _ in range(70):
        at = r.sample(range(100), r.choice((2, 5, 6, 7, 8)))
        if r.random() < 0.6:
            docs.append([w for i, w in enumerate(base) if i not in at])  # what is left out, others may leave out too
        else:
            docs.append([f"n{r.randrange(4)}" if i in at else w for i, w in enumerate(base)])
        if r.random() < 0.4:
            docs.append([w for i, w in enumerate(docs[-1]) if i != r.randrange(90)])
    docs = list(enumerate(docs, 1))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string").repartition(3)
    for rule in (minhash.OP6, minhash.FIVE_WORDS):
        found = {x.doc_id: x.component_id for x in minhash.grouped(df, rule=rule).collect()}
        assert found == brute(docs, rule.size, rule.threshold)
        assert 1 < len(set(found.values())) < len(docs)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "a B"), (4, "A b"), (None, "a b"), (5, long), (6, long + " more"), (7, "x"), (7, "x"), (8, "p q r s"), (8, "t u v w")]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "doc_id long, text string, rep string, n long")
    got = {(x.doc_id, x.n_shingles, x.component_id, x.kept) for x in minhash.grouped(df).collect()}
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (None, 1, None, True), (5, 29998, 5, True), (6, 29999, 5, False), (7, 1, 7, True), (8, 2, 8, True)}
    assert minhash.one_of_each(df).columns == df.columns and minhash.grouped(df.limit(0)).count() == 0
