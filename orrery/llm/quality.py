"""Quality classifier by co-training.

Two views of a document: its text (hashed words and the shape of words, lines and characters) and its metadata (source,
language, declared length). Each has a logistic classifier. One pass over whole texts writes both views of every document,
in half precision, to a table. Both classifiers start from a bounded sample of labelled rows. In each round each labels
the documents of the whole corpus of which it is most confident, SHARE more of them in each round and in the labelled
classes' proportion: a histogram of its odds over all documents says where that share begins. The other then trains on
these documents too, by steps of which each sums the gradient over all of them; together they weigh SHARE of the labelled
rows for each round. Then both are calibrated on labelled rows kept back, and a logistic combination of their calibrated
odds scores every document.

Bounds that a parameter states: LABELLED rows of each label. Nothing else is bounded: what a round counts, labels and
trains on are all documents, and what reaches the driver are histograms and gradients of fixed size from each task.

Defined cases: a null text counts as empty, null metadata as a value of its own; a null label teaches nothing; without
labels of both kinds the score is 0.5 and every document is kept; repeated rows repeat their result; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import MEMO_WORDS, logistic, sampled, sigmoid, written

LABELLED = 1200
ROUNDS, SHARE, STEPS = 3, 0.1, 2
#: Of the histograms: bins of odds from -EDGE to EDGE.
BINS, EDGE = 1200, 30.0
#: A pseudo-label needs a probability this far from an even one.
SURE = float(np.log(9.0))
BUCKETS = 256
SHAPE = 12


class Words(dict):
    """Of a raw word: bucket, whether it is upper case, holds a mark inside or at its end, or has no letter; remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        core = word.strip(".,;:!?\"'()")
        upper = len(core) > 1 and core.isupper()
        marks = sum(not c.isalnum() for c in core)
        code = zlib.crc32(core.lower().encode("utf-8", "surrogatepass")) % BUCKETS
        out = self[word] = code | upper << 8 | (marks > 0) << 9 | (not any(map(str.isalpha, core))) << 10 | (len(word) - len(core) > 1) << 11
        return out


def text_view(text: str | None, words: Words) -> np.ndarray:
    tokens = (text or "").split()
    n = max(1, len(tokens))
    codes = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
    counts = np.bincount(codes & (BUCKETS - 1), minlength=BUCKETS) / n
    flags = [((codes >> k) & 1).sum() / n for k in (8, 9, 10, 11)]
    same = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / n
    lines = (text or "").count("\n") + 1
    chars = len(text or "")
    shape = [*flags, same, len(set(tokens)) / n, np.log1p(len(tokens)), np.log1p(lines), chars / n / 10, lines / n, counts.max(initial=0), float(not tokens)]
    return np.concatenate([np.sqrt(counts), shape])


def metadata_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(64 + 16 + 16 + 3)
    out[zlib.crc32(repr(source).encode()) % 64] = 1
    out[64 + zlib.crc32(repr(lang).encode()) % 16] = 1
    size = np.log1p(max(0, n_chars or 0))
    out[80 + min(15, int(size))] = 1
    out[96:] = size / 10, (size / 10) ** 2, n_chars is None
    return out


class Model:
    def __init__(self, views: list[np.ndarray] | None, calibration=None, combined=None):
        self.views, self.calibration, self.combined = views, calibration, combined

    def scores(self, texts: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        """[row, (combined, text, metadata)]"""
        if self.views is None:
            return np.full((len(texts), 3), 0.5)
        z = calibrated(self.views, self.calibration, (texts, metadata))
        return np.stack([sigmoid(z @ self.combined[:-1] + self.combined[-1]), sigmoid(z[:, 0]), sigmoid(z[:, 1])], 1)


def odds(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def calibrated(views, calibration, xs) -> np.ndarray:
    return np.stack([a * odds(w, x) + b for w, (a, b), x in zip(views, calibration, xs, strict=True)], 1)


def features(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, t, m: both views of every document, written."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches):
        words = Words()
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                t = [text_view(x, words).astype(np.float16).tobytes() for x in part.column(1).to_pylist()]
                m = [metadata_view(*r).astype(np.float16).tobytes() for r in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(t, pa.binary()), pa.array(m, pa.binary())], names=["key", "t", "m"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), "source", "lang", F.col("n_chars").cast("long"))
    return written(rows.mapInArrow(run, f"key {kind}, t binary, m binary"), "views")


def unpacked(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float16).reshape(len(rows), -1).astype(np.float64) if rows else np.zeros((0, 0))


def summed(rows: DataFrame, size: int, work) -> np.ndarray:
    """The sum over all batches of the arrays of ``size`` numbers that ``work`` makes of (text view, metadata view)."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                total += work((unpacked(part.column(0)), unpacked(part.column(1))))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    parts = rows.select("t", "m").mapInArrow(run, "v array<double>")
    each = parts.select(F.posexplode("v").alias("k", "v")).where("v <> 0").groupBy("k").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for r in each.collect():  # ``size`` rows at most
        out[r["k"]] = r["v"]
    return out


def histogram(views: list[np.ndarray]):
    def work(xs):
        return np.concatenate([np.histogram(np.clip(odds(w, x), -EDGE, EDGE - 1e-9), BINS, (-EDGE, EDGE))[0] for w, x in zip(views, xs, strict=True)]).astype(float)

    return work


def limits(counts: np.ndarray, share: float, positive: float) -> tuple[float, float]:
    """(low, high): odds up to which, and from which on, a document is confidently 0 or 1: ``share`` of all documents,
    split by the share of positives, as whole bins; at least SURE from even odds."""
    edges = np.linspace(-EDGE, EDGE, BINS + 1)
    n = counts.sum()
    low = edges[np.searchsorted(np.cumsum(counts), share * n * (1 - positive), "right")]
    high = edges[BINS - np.searchsorted(np.cumsum(counts[::-1]), share * n * positive, "right")]
    return min(low, -SURE), max(high, SURE)


def gradients(views: list[np.ndarray], cuts: list[tuple[float, float]]):
    """Of each view: the number of documents that the other is sure of, and the gradient of the loss over them."""

    def work(xs):
        z = [odds(w, x) for w, x in zip(views, xs, strict=True)]
        out = []
        for v, x in enumerate(xs):
            low, high = cuts[1 - v]
            sure, y = (z[1 - v] <= low) | (z[1 - v] >= high), z[1 - v] >= high
            d = (sigmoid(z[v]) - y) * sure
            out += [[sure.sum()], d @ x, [d.sum()]]
        return np.concatenate(out)

    return work


def co_train(xs: tuple, y: np.ndarray, corpus: DataFrame, rounds: int = ROUNDS, share: float = SHARE) -> Model:
    """xs: the two views of labelled rows; corpus: t, m of all documents."""
    if len(set(y.tolist())) < 2:
        return Model(None)
    back = np.arange(len(y)) % 4 == 0  # kept back for calibration
    if len(set(y[~back].tolist())) < 2:
        back[:] = False
    own = [np.hstack([x[~back], np.ones(((~back).sum(), 1))]) for x in xs]
    label = y[~back]
    pull = [np.append(np.full(x.shape[1] - 1, 2.0), 1e-3) for x in own]
    views = [logistic(x[~back], label, 2.0) for x in xs]
    for r in range(1, rounds + 1):
        counts = summed(corpus, 2 * BINS, histogram(views)).reshape(2, BINS)
        if not counts.sum():
            break
        cuts = [limits(c, min(1.0, r * share), float(label.mean())) for c in counts]
        mass = r * share * len(label)
        for _ in range(STEPS):
            got = summed(corpus, sum(len(w) + 1 for w in views), gradients(views, cuts))
            new, at = [], 0
            for x, w, p in zip(own, views, pull, strict=True):
                n, g = got[at], got[at + 1 : at + 1 + len(w)]
                at += 1 + len(w)
                q = sigmoid(x @ w)
                # the labelled rows' curvature stands for all rows'; both gradients are exact
                curve = (x * (q * (1 - q))[:, None]).T @ x * (1 + mass / len(label)) + np.diag(p)
                slope = x.T @ (q - label) + p * w + (g * (mass / n) if n else 0)
                step = np.linalg.solve(curve, slope)
                new.append(w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12)))
            views = new
    held = [x[back] if back.any() else x for x in xs]
    y = y[back] if back.any() else y
    calibration = [logistic(odds(w, x)[:, None], y, 0.1, np.array([1.0, 0.0])) for w, x in zip(views, held, strict=True)]
    z = calibrated(views, calibration, held)
    return Model(views, calibration, logistic(z, y, 0.1, np.array([1.0, 0.2, 0.0])))


def train(corpus: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Model:
    """corpus: of :func:`features`."""
    rows = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y"))
    rows = rows.where(F.col("y").isNotNull() & F.col("key").isNotNull()).groupBy("key").agg(F.min("y").alias("y"))
    rows = sampled(rows.withColumn("y", (F.col("y") > 0).cast("int")), "y", "key", LABELLED)
    got = corpus.join(F.broadcast(rows), "key").limit(8 * LABELLED).toArrow()  # a bounded sample
    got = got.sort_by([("key", "ascending"), ("t", "ascending"), ("m", "ascending")])
    xs = tuple(unpacked(got.column(k)) for k in ("t", "m"))
    return co_train(xs, np.asarray(got.column("y"), float), corpus)


def score(corpus: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """The key, score, text_score, metadata_score and kept (score of 0.5 or more) of each row of :func:`features`."""
    kind = corpus.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                s = model.scores(unpacked(part.column(1)), unpacked(part.column(2)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(s[:, k]) for k in range(3)), pa.array(s[:, 0] >= 0.5)],
                    names=["key", "score", "text_score", "metadata_score", "kept"],
                )

    out = corpus.mapInArrow(run, f"key {kind}, score double, text_score double, metadata_score double, kept boolean")
    return out.withColumnRenamed("key", key)


def quality(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The scores of ``documents`` by a model of ``labels`` and of all documents."""
    corpus = features(documents, key, text)
    return score(corpus, train(corpus, labels, key, label), key)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op1_quality": op1_quality}
ORACLE_SQL: dict[str, str] = {}
