"""What a worker holds at once is bounded by texts' bytes, not by the rows of a batch."""

import random

import pyarrow as pa
import pytest

from orrery.llm import common, minhash

from .test_minhash import brute


def batch_of(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc", "text"])


@pytest.mark.parametrize("make", [minhash.signatures, minhash.sets])
def test_maps_take_a_batch_in_parts(make, monkeypatch):
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefgh") + str(r.randrange(900)) for _ in range(60)) for _ in range(200)] + [None, "", "x " * 9000, "y z"]
    whole = pa.Table.from_batches(list(make(minhash.FIVE_WORDS)(iter([batch_of(texts)]))))
    monkeypatch.setattr(common, "BATCH_CHARS", 4000)
    out = list(make(minhash.FIVE_WORDS)(iter([batch_of(texts), batch_of([])])))
    assert max(b.num_rows for b in out) <= 20 and len(out) > 10
    assert pa.Table.from_batches(out).equals(whole) and whole.num_rows >= 202


def test_parts_of_texts():
    sizes = [[len(t or "") for t in p.column(1).to_pylist()] for p in common.text_parts(batch_of(["a" * 3, None, "b" * 4, "c" * 50, "", "d"]), 1, 8)]
    assert sizes == [[3, 0, 4], [50], [0, 1]]
    assert list(common.text_parts(batch_of([]), 1)) == []


def test_bucket_keys_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(minhash, "KEY_ROWS", 8)
    r = random.Random(6)
    docs = []
    for _ in range(15):
        base = [f"w{r.randrange(400)}" for _ in range(90)]
        docs += [base, base[:-4], [w if r.random() > 0.02 else "new" for w in base]]
    docs = list(enumerate(docs, 1))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string").repartition(3)
    found = {x.doc_id: x.component_id for x in minhash.grouped(df, rule=minhash.FIVE_WORDS).collect()}
    assert found == brute(docs, minhash.FIVE_WORDS.size, minhash.FIVE_WORDS.threshold)
