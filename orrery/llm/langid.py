"""Language identification with string kernels.

The kernel of two texts is the blended spectrum's: the n-grams of 1 to N characters that both hold, each counted once,
over the root of the product of their numbers (of all n-grams of each text, known to a landmark or not). N-grams are of letters, lower-cased, with one break for anything else,
and hashed to BITS bits. A bounded sample of labelled rows gives LANDMARKS rows (Nyström) and trains one ridge regression
for each language against the rest. As the kernel is an inner product of presence vectors, the landmarks and the
regression's weights fold into one matrix: a batch of texts is scored by one product of its presence matrix with it, over
whole texts, in a map without a shuffle.

Bounds that a parameter states: SAMPLE labelled rows in all and texts of at most SAMPLE_CHARS characters in the sample;
no other text is bounded.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a text whose letters no landmark has gets
the first language; without labelled rows every text is ``und``. A null key is not held out. Repeated rows repeat their
result; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import given_back, sampled, text_parts, text_slices

N, BITS = 4, 18
SAMPLE, SAMPLE_CHARS, LANDMARKS = 1200, 20_000, 192
RIDGE = 1e-3
SHARP = 4.0
UNKNOWN = "und"
BREAK = 32

_letters: list[np.ndarray] = []


def _lower_letters() -> np.ndarray:
    """For each code point: its lower case if it is a letter, else BREAK."""
    if not _letters:
        table = np.full(0x110000, BREAK, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _letters.append(table)
    return _letters[0]


def grams(text: str) -> list[np.ndarray] | None:
    """Hashed n-grams, an array for each n; None if there is no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    c = _lower_letters()[points]
    if not (c != BREAK).any():
        return None
    c = np.concatenate([[BREAK], c, [BREAK]]).astype(np.uint32)
    out, h = [], c
    for n in range(1, N + 1):
        if n > 1:
            if len(c) < n:
                break
            h = h[:-1] * np.uint32(0x01000193) + c[n - 1 :]
        out.append(((h ^ np.uint32(n * 0x51ED27)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    return out


class Model:
    """languages; index: bucket to row of weights (0: in no landmark); weights: a column for each language."""

    def __init__(self, languages: list[str], index: np.ndarray, weights: np.ndarray):
        self.languages, self.index, self.weights = languages, index, weights

    def presence(self, found: list, rows: int = 64):
        """(positions, presence matrix, number of different n-grams) of runs of texts that have letters."""
        at = [i for i, g in enumerate(found) if g is not None]
        seen = np.zeros(1 << BITS, bool)
        for k in range(0, len(at), rows):
            some = at[k : k + rows]
            p = np.zeros((len(some), len(self.weights)), np.float32)
            sizes = np.ones(len(some))
            for k, (row, i) in enumerate(zip(p, some, strict=True)):
                for g in found[i]:
                    row[self.index[g]] = 1
                    seen[g] = True
                sizes[k] = np.count_nonzero(seen)
                for g in found[i]:
                    seen[g] = False
            p[:, 0] = 0
            yield some, p, sizes

    def scores(self, texts: list) -> tuple[list[str], list[float]]:
        labels, sure = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return labels, sure
        found = [grams(t) if t else None for t in texts]
        for some, p, sizes in self.presence(found):
            s = (p @ self.weights).astype(float) / np.sqrt(sizes)[:, None]
            e = np.exp(SHARP * (s - s.max(1, keepdims=True)))
            best = e.argmax(1)
            for i, b, v in zip(some, best, e[np.arange(len(best)), best] / e.sum(1), strict=True):
                labels[i], sure[i] = self.languages[b], float(v)
        return labels, sure


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """rows: (text, language), in any order."""
    rows = sorted((t, lang) for t, lang in rows if t and grams(t) is not None)
    languages = sorted({lang for _, lang in rows})
    index = np.zeros(1 << BITS, np.int32)
    if not rows:
        return Model([], index, np.zeros((1, 0), np.float32))
    found = [[np.unique(g) for g in grams(t)] for t, _ in rows]
    by_lang = {lang: [i for i, r in enumerate(rows) if r[1] == lang] for lang in languages}
    each = max(1, landmarks // len(languages))
    chosen = [i for own in by_lang.values() for i in own[:: max(1, len(own) // each)][:each]]
    used = np.unique(np.concatenate([g for i in chosen for g in found[i]]))
    index[used] = np.arange(1, len(used) + 1)
    model = Model(languages, index, np.zeros((len(used) + 1, 0), np.float32))
    land = np.vstack([p / np.sqrt(sizes)[:, None].astype(np.float32) for _, p, sizes in model.presence([found[i] for i in chosen])])
    kernel = np.zeros((len(rows), len(chosen)))
    for some, p, sizes in model.presence(found):
        kernel[some] = (p @ land.T) / np.sqrt(sizes)[:, None]
    inner = land.astype(float) @ land.T.astype(float)
    y = np.array([[1.0 if lang == x else -1.0 for x in languages] for _, lang in rows])
    left = kernel.T @ kernel + ridge * len(rows) * inner + 1e-8 * np.eye(len(chosen))
    alpha = np.linalg.solve(left, kernel.T @ y)
    return Model(languages, index, np.ascontiguousarray((land.T @ alpha).astype(np.float32)))


def train(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of a bounded sample of the rows with a language that are not held out."""
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("key"))
    rows = rows.where(F.length("text") <= SAMPLE_CHARS)
    kinds = rows.select("lang").distinct().count()
    got = sampled(rows, "lang", "key", max(2, SAMPLE // max(1, kinds))).select("text", "lang").collect()
    return fit([(r["text"], r["lang"]) for r in got])


def held_out(key: str):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def predict(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, lang_pred and score of each row."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            labels, sure = [], []
            for a, b in text_slices(texts):
                found = model.scores(texts[a:b])
                labels += found[0]
                sure += found[1]
            cols = [batch.column(0), pa.array(labels, pa.string()), pa.array(sure, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "lang_pred", "score"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def known(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that are in some language, with all their columns: those with a letter."""
    names = documents.columns
    batchable = documents.select(*names)

    def run(batches):
        for batch in (part for batch in batches for part in text_parts(batch, names.index(text))):
            labels = model.scores(batch.column(names.index(text)).to_pylist())[0]
            yield batch.filter(pa.array([x != UNKNOWN for x in labels], pa.bool_()))

    return batchable.mapInArrow(given_back(run), documents.schema)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
ORACLE_SQL: dict[str, str] = {}
