import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from orrery.llm import bpe

from .test_learned import near
from .test_native import brute as hits
from .test_recompress import brute as removed


def expected(docs, items):
    """The pipeline by brute force, with the rows of each stage."""
    docs = [(d, t) for d, t in docs if t and any(c.isalpha() for c in t)]
    kept = {d for d, _, _, own in near(docs, 5, 80) if own}  # five words and 0.8: the rule of stages
    docs = [(d, t) for d, t in docs if d in kept]
    first, out = set(), []
    for d, t in sorted(docs):
        w, gone = t.encode().split(), set()
        for i in range(len(w) - 19):
            window = tuple(w[i : i + 20])
            gone |= set(range(i, i + 20)) if window in first else set()
            first.add(window)
        left = b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else t
        if left or not gone:
            out.append((d, left))
    dirty = {r[0] for r in hits(out, items) if r[-1]}
    tokenizer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.vocabulary_path()), special_tokens={})
    rows = []
    for d, t in out:
        if d not in dirty:
            ids = tokenizer.encode_ordinary(t)
            rows.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(rows)


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    extra = spark.createDataFrame([(90001, None, None, "s", 0), (90002, "123 ... 456", None, "s", 11), (90003, "", "en", "s", 0)], docs.schema)
    docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = expected([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == want
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_removed_is_the_same_brute_force():
    assert removed([(1, "a b")])[0][:3] == (1, 2, 0)
