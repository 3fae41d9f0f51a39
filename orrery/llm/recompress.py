"""Substring dedup by recompression.

Each text becomes a sequence of 64-bit word names. The first round names runs of an equal word; each round names pairs of
neighbours whose first is in the left and whose second is in the right half of all names (halves by a hash of the name
and the round). (Runs of higher symbols are left as they are: naming them would make each symbol depend on both of its
neighbours in each round, and fewer would be interior to a window.)
A name is a hash of what it stands for, so all workers give equal runs and pairs the same global name without a
table, and equal substrings get the same interior symbols. With each symbol go the words that its existence depends on
(its own, and of a neighbour where that decided how it was read). A symbol is interior to a window of WINDOW words if all
these lie in the window; of the interior symbols of the highest round that has any, the one of least name stands for the
window, under a hash of all the words that it depends on. Equal windows have equal symbols standing for them, so a window can only repeat if its symbol does.

0. by text hash: copies of a whole text lose all their words (if they have a window); the steps below leave them out.
1. map: the symbols that stand for windows, an occurrence each.
2. by name: which occurrences have another elsewhere.
3. by document: the windows whose symbol repeats are candidates; their 96-bit hashes verify them.
4. by window hash: all but the first occurrence (smallest document, then start) are repeats.
5. by document: the words that repeats cover are removed.

Before both shuffles by name and hash, a worker settles what meets in its own batch: of equal names or hashes one row goes
on, and the rest go on as settled rows with keys of their own. So one row of a key leaves a batch, however many copies
the corpus holds. The text is shuffled once, by document, and all joins by document use that exchange.

Names and windows are compared by hashes, of 64 and 96 bits, and whole copies by MD5: words are not compared themselves.

Defined cases: a null text, or one without a word, has no words; fewer than WINDOW words are never removed; a row that
repeats (equal id and text) is the same document; of rows of equal id and different texts each is a document of its own,
and the one of the smaller text hash comes earlier; a document without an id is left as it is; extra columns are kept by
``dedup`` and ignored by the query; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import WordHashes, mix, small, text_slices, written

WINDOW = 20
ROUNDS = 3
#: Characters that a worker turns into arrays at once.
BATCH_TEXT = 4_000_000
#: Keys of several texts that are broadcast at most.
BROADCAST_ROWS = 1_000_000
VERSION = "__version"
U = np.uint64


def parsed(words: np.ndarray, breaks: np.ndarray):
    """Per round, from 0: (names, first word from which a symbol depends, last such word + 1).

    words: names of words, with one position between texts (breaks: those positions), which merges with nothing."""
    n = len(words)
    name = words.copy()
    fixed = np.zeros(n, bool)
    fixed[breaks] = True
    lo, hi = np.arange(n, dtype=np.int64), np.arange(1, n + 1, dtype=np.int64)
    yield name, lo, hi, fixed
    for r in range(1, ROUNDS + 1):
        if r == 1:  # runs of a word
            new = np.ones(len(name), bool)
            new[1:] = (name[1:] != name[:-1]) | fixed[1:] | fixed[:-1]
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(name)))
            last = start + size - 1
            long = size > 1
            # a symbol, long run or not, depends on the neighbours that end it
            run_lo, run_hi = np.append(-1, lo[last[:-1]]), np.append(hi[start[1:]], n + 1)
            name = np.where(long, mix(name[start] + U(0x9E3779B97F4A7C15) * size.astype(U)), name[start])
            fixed, lo, hi = fixed[start], run_lo, run_hi
        # pairs
        right = (mix(name ^ U(r * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)) >> U(63)).astype(bool)
        first = np.zeros(len(name), bool)
        first[:-1] = ~right[:-1] & right[1:] & ~fixed[:-1] & ~fixed[1:]
        second = np.zeros(len(name), bool)
        second[1:] = first[:-1]
        # a symbol that stayed alone depends on the neighbour that might have taken it
        new_lo, new_hi = lo.copy(), hi.copy()
        alone = ~first & ~second & ~fixed
        left_ok, right_ok = alone & right, alone & ~right
        prev, nxt = np.append(-1, lo[:-1]), np.append(hi[1:], n + 1)
        new_lo[left_ok] = np.minimum(lo, prev)[left_ok]
        new_hi[right_ok] = np.maximum(hi, nxt)[right_ok]
        at = np.flatnonzero(first)
        pair = mix(name[at] * U(0xD1342543DE82EF95) + mix(name[at + 1] + U(1)))
        new_lo[at] = np.minimum(lo[at], lo[at + 1])
        new_hi[at] = np.maximum(hi[at], hi[at + 1])
        name = name.copy()
        name[at] = pair
        keep = ~second
        name, lo, hi, fixed = name[keep], new_lo[keep], new_hi[keep], fixed[keep]
        yield name, lo, hi, fixed


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def span_names(words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of the words from lo to hi: of all that a symbol depends on, so it says more than the symbol's own name."""
    base = 0x9E3779B97F4A7C15
    sums = np.append(U(0), np.cumsum(mix(words) * powers(base, len(words))))
    return mix((sums[hi] - sums[lo]) * powers(pow(base, -1, 1 << 64), len(words) + 1)[lo] + (hi - lo).astype(U))


def standing(words: np.ndarray, breaks: np.ndarray):
    """(names, positions, of) - a symbol for each window: of[p] is the index of the symbol that stands for the window at
    p (-1: a break is in it). It is the one of least name among those of the highest round that has any in the window.
    The symbols of a text are in an order that does not depend on the texts around it."""
    n = len(words)
    starts = max(0, n - WINDOW + 1)
    of = np.full(starts, -1, np.int64)
    broken = np.zeros(n + 1, np.int64)
    broken[breaks + 1] = 1
    broken = np.cumsum(broken)
    open_ = np.flatnonzero(broken[WINDOW:] == broken[: n - WINDOW + 1]) if starts else np.zeros(0, np.int64)
    names, positions, count = [], [], 0
    for r, (name, lo, hi, _) in reversed(list(enumerate(parsed(words, breaks)))):
        if not len(open_):
            break
        first, end = np.searchsorted(lo, open_), np.searchsorted(hi, open_ + WINDOW, side="right")
        has = end > first
        at, first, end = open_[has], first[has], end[has]
        open_ = open_[~has]
        rank = mix(name + U(r + 1))
        best = first.copy()
        for k in range(1, int((end - first).max(initial=0))):
            more = np.minimum(first + k, end - 1)
            best = np.where(rank[more] < rank[best], more, best)
        used, own = np.unique(best, return_inverse=True)
        of[at] = own + count
        count += len(used)
        names.append(span_names(words, lo[used], hi[used]))
        positions.append(np.maximum(lo[used], 0))
    if not names:
        return np.zeros(0, U), np.zeros(0, np.int64), of
    return np.concatenate(names), np.concatenate(positions), of


class Batch:
    """The words of some texts in one array, with a break after each text."""

    def __init__(self, texts: list, hashes: WordHashes):
        split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        self.lengths = np.array([len(w) for w in split], np.int64)
        self.ends = np.cumsum(self.lengths + 1)
        self.starts = self.ends - self.lengths - 1
        self.words = np.zeros(int(self.ends[-1]) if len(self.ends) else 0, U)
        for s, w in zip(self.starts.tolist(), split, strict=True):
            self.words[s : s + len(w)] = hashes.of(w)
        self.breaks = self.ends - 1
        self.split = split

    def text_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, position, side="right")


def only_firsts(key: np.ndarray):
    """(order, first): rows sorted by key, input order kept, and which is its key's first."""
    order = np.argsort(key, kind="stable")
    first = np.ones(len(order), bool)
    first[1:] = key[order][1:] != key[order][:-1]
    return order, first


def _batches(batches):
    hashes = WordHashes()
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in text_slices(texts, BATCH_TEXT):
            yield batch.slice(a, b - a), Batch(texts[a:b], hashes)


def symbols(batches):
    """Step 1: key, seen (2 if it is settled that it repeats), doc and version, and the ordinal of the symbol in its text.
    batches: doc, text, version."""
    for batch, words in _batches(batches):
        name, position, _ = standing(words.words, words.breaks)
        if not len(name):
            continue
        text = words.text_of(position)
        ordinal = numbered(text)
        order, first = only_firsts(name)
        group = np.cumsum(first) - 1
        rest = np.zeros(len(name), bool)
        rest[order] = ~first
        seen = np.empty(len(name), np.int32)
        seen[order] = np.where(np.bincount(group)[group] > 1, 2, 1)
        doc, version = (np.asarray(batch.column(k))[text] for k in (0, 2))
        key = name.copy()
        key[rest] = own_key(key[rest], doc[rest], version[rest], ordinal[rest])
        at = np.lexsort((ordinal, text))  # rows in the texts' order compress well in a shuffle
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[at].view(np.int64)), pa.array(seen[at]), pa.array(doc[at]), pa.array(version[at]), pa.array(ordinal[at].astype(np.int32))],
            names=["key", "seen", batch.schema.names[0], VERSION, "at"],
        )


def own_key(key: np.ndarray, doc: np.ndarray, version: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A key that no other row has."""
    return mix(key ^ mix(mix(doc.astype(U) ^ mix(version.astype(U))) * U(0x9E3779B97F4A7C15) + at.astype(U)))


def numbered(text: np.ndarray) -> np.ndarray:
    """The ordinal of each row among those of its text, in the order given."""
    order = np.argsort(text, kind="stable")
    first = np.searchsorted(text[order], text[order], side="left")
    out = np.empty(len(text), np.int64)
    out[order] = np.arange(len(text)) - first
    return out


def candidates(batches):
    """Step 3: h1, h2, doc, version, start, settled (a repeat for certain) of the windows whose symbols all repeat.
    batches: doc, text, version, ordinals."""
    weights = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], U)
    more = np.array([pow(0xD1342543DE82EF95, k, 1 << 64) for k in range(WINDOW)], U)
    for batch, words in _batches(batches):
        name, position, of = standing(words.words, words.breaks)
        if not len(name):
            continue
        text = words.text_of(position)
        ordinal = numbered(text)
        listed = batch.column(3)
        owner = np.repeat(np.arange(len(listed)), np.asarray(listed.value_lengths().fill_null(0)))
        width = int(ordinal.max()) + 1
        repeated = np.isin(text * width + ordinal, owner * width + np.asarray(listed.flatten()))
        possible = np.append(repeated, False)[of]
        start = np.flatnonzero(possible)
        if not len(start):
            continue
        h1, h2 = np.zeros(len(start), U), np.zeros(len(start), U)
        scrambled = mix(words.words + U(0x5851F42D4C957F2D))
        for k in range(WINDOW):
            h1 += words.words[start + k] * weights[k]
            h2 += scrambled[start + k] * more[k]
        h1, h2 = mix(h1), (mix(h2) >> U(32)).astype(np.int64)
        text = words.text_of(start)
        doc, version = (np.asarray(batch.column(k))[text] for k in (0, 2))
        local = start - words.starts[text]
        order = np.lexsort((local, version, doc, h2, h1))
        same = np.zeros(len(order), bool)
        same[1:] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        later = np.zeros(len(order), bool)
        later[order] = (doc[order] != doc[first]) | (version[order] != version[first]) | (local[order] != local[first])
        h1[later] = own_key(h1[later], doc[later], version[later], local[later])
        yield pa.RecordBatch.from_arrays(
            [pa.array(h1.view(np.int64)), pa.array((h2 - (1 << 31)).astype(np.int32)), pa.array(doc), pa.array(version), pa.array(local.astype(np.int32)), pa.array(later)],
            names=["h1", "h2", batch.schema.names[0], VERSION, "start", "settled"],
        )


def spans_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """Merged (start, end) of the windows that start there."""
    if not len(starts):
        return []
    s = np.unique(starts)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > s[:-1] + WINDOW
    first = s[new]
    last = np.append(s[np.flatnonzero(new)[1:] - 1], s[-1])
    return list(zip(first.tolist(), (last + WINDOW).tolist(), strict=True))


def repeats(rows: DataFrame, key: str, text: str, more: list[str] = []) -> DataFrame:  # noqa: B006
    """rows: key (long), text and ``more``. key, text, starts (of repeated windows; null if none), copy (whether the whole
    text is also that of a smaller key) and ``more``. Names stay as in ``rows``: a renamed column would be another exchange,
    and so would be ``more`` beside the text: it comes in at the end, by a join of its own."""
    doc, own_key = F.col(key), [key, VERSION]
    nameless = rows.where(doc.isNull()).select(key, text, F.lit(None).cast("array<int>").alias("starts"), F.lit(False).alias("copy"), *more)
    whole, again = with_version(rows.where(doc.isNotNull()), key, text)
    texts = whole.select(key, text, VERSION)
    if again:
        texts = texts.dropDuplicates(own_key)
    sums = texts.where(F.col(text).isNotNull()).select(F.struct(*own_key).alias("doc"), F.md5(text).alias("sum"))
    firsts = sums.groupBy("sum").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    firsts = written(firsts.select("sum", "first"), "firsts")  # a hot text is then a join that adaptive execution can split
    copies = sums.join(firsts, "sum").where("doc > first").select("doc.*", F.lit(True).alias("copy"))
    own = texts.join(copies, own_key, "left_anti").select(key, text, VERSION)
    marks = own.mapInArrow(symbols, f"key long, seen int, `{key}` long, {VERSION} long, at int")
    by_name = Window.partitionBy("key")
    marks = marks.withColumn("n", F.sum("seen").over(by_name)).where(F.col("n") > 1)
    marks = marks.groupBy(*own_key).agg(F.collect_list("at").alias("at"))
    some = own.join(marks, own_key).select(key, text, VERSION, "at")
    wins = some.mapInArrow(candidates, f"h1 long, h2 int, `{key}` long, {VERSION} long, start int, settled boolean")
    by_hash = Window.partitionBy("h1", "h2").orderBy(*own_key, "start")
    wins = wins.withColumn("n", F.dense_rank().over(by_hash)).where((F.col("n") > 1) | F.col("settled"))
    starts = wins.groupBy(*own_key).agg(F.collect_list("start").alias("starts"))
    out = texts.join(starts, own_key, "left").join(copies, own_key, "left")
    out = out.select(*own_key, text, "starts", F.coalesce("copy", F.lit(False)).alias("copy"))
    if more or again:
        out = out.join(whole.select(*own_key, *more), own_key)
    return out.select(key, text, "starts", "copy", *more).unionByName(nameless)


def with_version(rows: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """``rows`` with VERSION: 0, or a hash of the text where rows of that key have different texts; and whether any key
    has several rows."""
    version = F.xxhash64(text)
    several = rows.groupBy(key).agg(F.min(version).alias("a"), F.max(version).alias("b"), F.count("*").alias("n")).where("n > 1")
    several = written(several.select(key, (F.col("a") < F.col("b")).alias("__several")), "versions")
    n = several.count()
    if not n:
        return rows.withColumn(VERSION, F.lit(0).cast("long")), False
    out = rows.join(small(several.where("__several"), n, BROADCAST_ROWS), key, "left")
    return out.withColumn(VERSION, F.when(F.col("__several"), version).otherwise(F.lit(0).cast("long"))).drop("__several"), True


def finish(what: str):
    """what: "digest" (n_words, n_removed, kept_sha256) or "text" (the kept words, joined by a space)."""

    def run(batches):
        for batch in batches:
            out = []
            for text, starts, copy in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                spans = spans_of(np.asarray(starts.values)) if starts.is_valid else []
                if copy and len(words) >= WINDOW:
                    spans = [(0, len(words))]
                kept, at, n = [], 0, 0
                for a, b in spans:
                    kept += words[at:a]
                    n += b - a
                    at = b
                kept += words[at:]
                joined = b" ".join(kept)
                if what == "digest":
                    out.append((len(words), n, hashlib.sha256(joined).hexdigest()))
                else:
                    out.append((joined.decode() if n else text, n))
            cols = list(zip(*out, strict=True)) or [[]] * (3 if what == "digest" else 2)
            kinds = [pa.int64(), pa.int64(), pa.string()] if what == "digest" else [pa.string(), pa.int64()]
            names = ["n_words", "n_removed", "kept_sha256"] if what == "digest" else ["text", "n_removed"]
            rest = [] if batch.num_columns == 4 else [batch.column(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)), *rest],
                names=["doc", *names, *(["rest"] if rest else [])],
            )

    return run


def digests(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, n_words, n_removed and kept_sha256 of each row. The key is a whole number."""
    out = repeats(documents.select(_long(documents, key), text), key, text)
    return out.mapInArrow(finish("digest"), "doc long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("doc", key)


def _long(documents: DataFrame, key: str):
    return F.col(key) if documents.schema[key].dataType.simpleString() == "bigint" else F.col(key).cast("long").alias(key)


def dedup(documents: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``documents`` with the repeated words removed: a text that loses words is its kept words, joined by a space, and
    its ``n_chars`` (if there is such a column) is counted anew; documents of which no word is left go. The other texts and
    all other columns stay as they are."""
    rows = documents.select(_long(documents, key), text, F.struct(F.lit(0).alias("__"), *(c for c in documents.columns if c != text)).alias("rest"))
    starts = repeats(rows, key, text, ["rest"])
    kind = rows.schema["rest"].dataType.simpleString()
    out = starts.mapInArrow(finish("text"), f"doc long, text string, n_removed long, rest {kind}")
    out = out.where((F.col("n_removed") == 0) | (F.col("text") != ""))
    changed = F.col("n_removed") > 0
    columns = {c: F.col("text") if c == text else F.col(f"rest.`{c}`") for c in documents.columns}
    if n_chars in columns:
        columns[n_chars] = F.when(changed, F.length("text").cast(documents.schema[n_chars].dataType)).otherwise(columns[n_chars])
    return out.select(*(c.alias(name) for name, c in columns.items()))


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
