"""What the operators share: tables in the shared folder, size-checked broadcasts, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AZ, AZ_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words kept in a worker's dictionary before it starts anew: a bound on memory, not on results.
MEMO_WORDS = 400_000
#: Text that a worker turns into arrays at once; a longer document is a batch of its own.
BATCH_CHARS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and all runs on one machine, as
    in tests, one of our own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='orrery-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, which cuts its lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that no later plan reads."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.table_path)
        with contextlib.suppress(Exception):
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within ``limit``; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def lower_az(text: Column) -> Column:
    """A-Z in lower case, and no other letter."""
    return F.when(text.rlike("[A-Z]"), F.translate(text, AZ, AZ_LOWER)).otherwise(text)


def literal(value_json: str, schema: str) -> Column:
    """A nested constant; the optimizer folds the parse into one literal."""
    return F.from_json(F.lit(value_json), schema)


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to MEMO_WORDS."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_slices(texts: list, most: int = BATCH_CHARS):
    """(start, end) of runs of rows with at most ``most`` characters, or one row."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def text_parts(batch: pa.RecordBatch, k: int, most: int | None = None):
    """``batch`` in slices with at most ``most`` (BATCH_CHARS) bytes in its column ``k`` of texts, or of one row."""
    most = BATCH_CHARS if most is None else most
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(k)), 0).to_pylist()):
        if i > start and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def given_back(run):
    """``run`` (batches to batches); what it has freed goes back to the system at its end, as its worker stays for other tasks."""

    def mapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # glibc only
                ctypes.CDLL(None).malloc_trim(0)

    return mapped


def sampled(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """About ``most`` rows at most of each value of ``by``, by a hash of ``key``: the same rows wherever it runs."""
    counts = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    share = F.lit(0)
    for value, n in counts.items():
        if value is not None:
            share = F.when(F.col(by) == F.lit(value), F.lit(min(1_000_000, -(-most * 1_000_000 // n)))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1_000_000)) < share).limit(2 * most * max(1, len(counts)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, prior: np.ndarray | None = None, steps: int = 40) -> np.ndarray:
    """Newton's method for a logistic regression whose last weight is the bias; weights are drawn towards ``prior``."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w0 = np.zeros(x.shape[1]) if prior is None else prior
    pull = np.full(x.shape[1], l2)
    pull[-1] = 1e-3
    w = w0.copy()
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (p - y) + pull * (w - w0)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
