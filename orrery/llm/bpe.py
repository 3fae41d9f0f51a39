"""Byte-level BPE encoding and decoding.

Spark higher-order functions fold the ranked merges over the bytes of distinct words: the state is the array of pieces
and the array of ranks of neighbouring pairs, each step merges the leftmost pair of least rank and looks up the two ranks
that changed. The ranks are a literal map, split into buckets by CRC-32 so that a lookup is short. The words are the most
frequent of the whole corpus, HEAD_WORDS at most (a bound that no input moves), and so nearly all occurrences. A map
over the documents, without a shuffle, then splits each text by the pattern and puts the codes in place; it merges the
rare words itself, once for each task, as their number grows with the corpus and a fold costs tens of
microseconds a word (README). Which words are in the head changes no result. Decoding concatenates the binary pieces.

No match of the pattern goes on from another character to a space, so the count can cut a text before each space that
follows one and match each different unit once. A worker's table starts anew after TABLE_WORDS words or units, so memory is
bounded.

Defined cases: a null text counts as empty and has no ids; repeated rows repeat their result; extra columns are ignored
(one key column is kept, null or not); an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import literal, text_slices, written

HEAD_WORDS = 65_536
TABLE_WORDS = 400_000
TABLE_CHARS = 8_000_000
LONG_WORD = 200
SHORT_WORD = 48
#: The pattern of which the text above speaks, and the pairs that may keep str.split from cutting at the right spaces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = [f"{c} " for c in map(chr, range(0x3001)) if c.isspace()]
BUCKETS = 65_536
NO_RANK = 2_147_483_647
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word: a heap of pairs over a linked list."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != e:
            continue
        alive[j] = False
        end[i] = e
        if e < n:
            before[e] = i
            offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def cutter(split: str):
    """text -> (first unit, the others without the space that each begins with). One unit for another pattern."""
    if split != PATTERN:
        return lambda text: (text, [])
    anywhere = re.compile(r"(?<!\s) ").split

    def cut(text: str) -> tuple[str, list[str]]:
        units = anywhere(text) if any(s in text for s in SPACES) else text.split(" ")
        return units[0], units[1:]

    return cut


class Merges:
    """Ranked merges of many words at once: a row of ids for each word, and of the ranks of neighbouring pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.none = max(ranks.values(), default=0) + 1
        self.of_byte = np.array([ranks.get(bytes([b]), self.none) for b in range(256)], np.int64)
        halves = ((p[:k], p[k:], r) for p, r in ranks.items() for k in range(1, len(p)))
        flat = (x for a, b, r in halves if a in ranks and b in ranks for x in (ranks[a] * (self.none + 1) + ranks[b], r))
        self.keys, self.values = np.fromiter(flat, np.int64).reshape(-1, 2).T.copy()
        self.table()

    def __getstate__(self):
        known = self.keys >= 0  # a worker builds the table anew: it is mostly empty
        return self.none, self.of_byte, self.keys[known], self.values[known]

    def __setstate__(self, state):
        self.none, self.of_byte, self.keys, self.values = state
        self.table()

    def table(self) -> None:
        keys, values = self.keys, self.values
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        at = self.slot(keys)
        while len(keys):  # open addressing: of those that want a free slot, one gets it
            free = np.flatnonzero(self.keys[at] < 0)
            slots, first = np.unique(at[free], return_index=True)
            got = free[first]
            self.keys[slots], self.values[slots] = keys[got], values[got]
            left = np.ones(len(keys), bool)
            left[got] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NO_RANK where they don't merge. One dimension."""
        keys = left * (self.none + 1) + right
        at = self.slot(keys)
        out, left_over = self.values[at], np.flatnonzero(self.keys[at] != keys)
        out[left_over] = NO_RANK
        left_over = left_over[self.keys[at[left_over]] >= 0]
        while len(left_over):
            at[left_over] = (at[left_over] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[left_over]]
            hit = found == keys[left_over]
            out[left_over[hit]] = self.values[at[left_over[hit]]]
            left_over = left_over[~hit & (found >= 0)]
        return out

    def of(self, words: list[bytes]):
        """(word, its ids as little-endian 32-bit integers) of each word of 1 to SHORT_WORD bytes, in an order of its own."""
        words = sorted(words, key=len)
        for a in range(0, len(words), 4096):
            some = words[a : a + 4096]
            yield from self._of(some, len(some[-1]))

    def _of(self, words: list[bytes], width: int):
        ids = self.of_byte[np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)]
        size = np.array([len(w) for w in words])
        ids[np.arange(width)[None] >= size[:, None]] = self.none
        ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), width - 1)
        row = np.arange(len(words))
        while len(row):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            least = ranks[np.arange(len(row)), at] if ranks.shape[1] else np.full(len(row), NO_RANK)
            over = least == NO_RANK
            if over.any():
                done = ids[over]
                there = done != self.none
                raw = done[there].astype("<u4").tobytes()
                ends = (4 * np.cumsum(there.sum(1))).tolist()
                for r, start, end in zip(row[over].tolist(), [0, *ends[:-1]], ends, strict=True):
                    yield words[r], raw[start:end]
                going = ~over
                row, ids, ranks, at, least = row[going], ids[going], ranks[going], at[going], least[going]
                if not len(row):
                    return
            n, width = np.arange(len(row)), ids.shape[1]
            ids[n, at] = least
            columns = np.arange(width - 1)
            ids = np.take_along_axis(ids, columns[None] + (columns[None] > at[:, None]), 1)
            ranks = np.take_along_axis(ranks, columns[None, : width - 2] + (columns[None, : width - 2] >= at[:, None]), 1)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            ranks[before, at[before] - 1] = self.rank(ids[before, at[before] - 1], ids[before, at[before]])
            ranks[after, at[after]] = self.rank(ids[after, at[after]], ids[after, at[after] + 1])


class Codes:
    """The ids of texts. Words that it doesn't hold yet are merged together, for some texts at a time. head: ids of words."""

    def __init__(self, ranks: dict[bytes, int], head: dict[str, bytes], split: str, merges: Merges):
        import regex

        self.ranks, self.head, self.merges = ranks, head, merges
        self.find = regex.compile(split).findall
        self.words = dict(head)
        self.chars = 0

    def learn(self, words: set[str]) -> None:
        short = []
        for w in words:
            raw = w.encode()
            if raw in self.ranks:
                self.words[w] = struct.pack("<I", self.ranks[raw])
            elif len(raw) <= SHORT_WORD:
                short.append(raw)
            else:
                ids = merged(raw, self.ranks)
                self.words[w] = struct.pack(f"<{len(ids)}I", *ids)
        for raw, ids in self.merges.of(short):
            self.words[raw.decode()] = ids

    def texts(self, texts: list) -> list[bytes]:
        if len(self.words) > len(self.head) + TABLE_WORDS or self.chars > TABLE_CHARS:
            self.words, self.chars = dict(self.head), 0
        found = [self.find(t) if t else [] for t in texts]
        new: set[str] = set()
        for words in found:
            new.update(words)
        new.difference_update(self.words)
        self.chars += sum(map(len, new))
        self.learn(new)
        return [b"".join(map(self.words.__getitem__, words)) for words in found]


def counted(ranks: dict[bytes, int], split: str):
    """(word, n) of the words in units that a task meets twice or more between two times of emptying its table, but for
    the first of a text. (What is left out here costs a merge, and changes no result.)"""

    def run(batches):
        import regex

        find, cut = regex.compile(split).findall, cutter(split)
        units: Counter = Counter()

        def out():
            counts: Counter = Counter()
            for unit, n in units.items():
                if n > 1:
                    for w in find(f" {unit}"):
                        counts[w] += n
            units.clear()
            kept = [(w, n) for w, n in counts.items() if len(w) <= LONG_WORD // 4 and w.encode() not in ranks]
            return pa.RecordBatch.from_arrays(
                [pa.array([w.encode().decode("latin-1") for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())],
                names=["word", "n"],
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    first, others = cut(text)
                    units.update(others)
                if len(units) >= TABLE_WORDS:
                    yield out()
        yield out()

    return run


def fold(word: Column, ranks: Column) -> Column:
    """The ids of a word, given as a character (of Latin-1) for each byte. ranks: the literal buckets."""

    def rank(s: Column) -> Column:
        at = F.pmod(F.crc32(s.cast("binary")), F.lit(BUCKETS)).cast("int")
        return F.coalesce(F.get(ranks, at)[s], F.lit(NO_RANK))

    def state(p: Column, r: Column) -> Column:
        return F.struct(p.alias("p"), r.alias("r"))

    none = F.array().cast("array<int>")

    def merge(s: Column) -> Column:
        p, r = s["p"], s["r"]

        def at(q: Column) -> Column:
            pair = F.concat(F.get(p, q - 1), F.get(p, q))
            left = F.when(q > 1, F.array(rank(F.concat(F.get(p, q - 2), pair)))).otherwise(none)
            right = F.when(q < F.size(r), F.array(rank(F.concat(pair, F.get(p, q + 1))))).otherwise(none)
            return state(
                F.concat(F.slice(p, F.lit(1), q - 1), F.array(pair), F.slice(p, q + 2, F.size(p))),
                F.concat(F.slice(r, F.lit(1), F.greatest(q - 2, F.lit(0))), left, right, F.slice(r, q + 2, F.size(r))),
            )

        return F.transform(F.array(F.array_position(r, F.array_min(r)).cast("int")), at)[0]

    chars = F.filter(F.split(word, ""), lambda c: c != "")
    pairs = F.transform(
        F.sequence(F.lit(1), F.length(word) - 1), lambda i: rank(F.substring(word, i, F.lit(2)))
    )
    start = state(chars, F.when(F.length(word) > 1, pairs).otherwise(none))
    steps = F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1)))
    done = F.aggregate(
        steps,
        start,
        lambda s, _: F.when(F.coalesce(F.array_min(s["r"]), F.lit(NO_RANK)) == NO_RANK, s).otherwise(merge(s)),
        lambda s: F.transform(s["p"], rank),
    )
    whole = rank(word)
    return F.when(whole != NO_RANK, F.array(whole)).when(word == "", none).otherwise(done)


def frequent(documents: DataFrame, text: str, ranks: dict[bytes, int]) -> DataFrame:
    """At most HEAD_WORDS distinct words, the most frequent over all documents, and their ids by :func:`fold`."""
    words = documents.select(text).mapInArrow(counted(ranks, pattern()), "word string, n long")
    words = written(words.groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = least = 0
    levels = words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(HEAD_WORDS).collect()
    for r in levels:
        if total + r["words"] > HEAD_WORDS:
            break
        total, least = total + r["words"], r["n"]
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, r in ranks.items():
        s = piece.decode("latin-1")
        buckets[zlib.crc32(s.encode()) % BUCKETS][s] = r
    table = literal(json.dumps(buckets), "array<map<string,int>>")
    ids = F.transform(F.array(table), lambda t: fold(F.col("word"), t))[0]  # binds the literal: it is in the plan once
    few = words.where((F.col("n") >= least) & (F.lit(total) > 0)).select("word")
    few = written(few.repartition(max(1, total // 4096)), "few")
    # one job without an exchange: adaptive execution would describe the plan again after each, and the driver keeps every
    # description, with the whole literal in it; read back part by part, each part would be a job that ships the literal
    return written(few.select("word", ids.alias("ids")), "head")


def coded(ranks: dict[bytes, int], head: dict[str, bytes], split: str, what: str):
    """what: "ids" (n_tokens and the ids) or "digests" (n_tokens and SHA-256 of the ids and of the decoded)."""
    pieces, merges = Pieces(ranks), Merges(ranks)

    def run(batches):
        codes = Codes(ranks, head, split, merges)
        for batch in batches:
            out, texts = [], batch.column(1).to_pylist()
            for raw in (raw for a, b in text_slices(texts) for raw in codes.texts(texts[a:b])):
                ids = np.frombuffer(raw, "<u4")
                if what == "ids":
                    out.append((len(ids), ids.astype(np.int32)))
                else:
                    out.append((len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(pieces.of(ids)).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * (2 if what == "ids" else 3)
            kinds = [pa.int64(), pa.list_(pa.int32())] if what == "ids" else [pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))],
                names=["key", "n_tokens", *(["ids"] if what == "ids" else ["ids_sha256", "decoded_sha256"])],
            )

    return run


class Pieces:
    """The binary pieces of ids, one after another in one buffer."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, r in ranks.items():
            by_id[r] = piece
        self.size = np.array([len(p) for p in by_id], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.buffer = np.frombuffer(b"".join(by_id), np.uint8)

    def of(self, ids: np.ndarray) -> bytes:
        """The pieces of ``ids``, joined."""
        out = []
        for a in range(0, len(ids), 100_000):
            some = ids[a : a + 100_000].astype(np.int64)
            size = self.size[some]
            end = np.cumsum(size)
            out.append(self.buffer[np.repeat(self.at[some] - end + size, size) + np.arange(end[-1])].tobytes())
        return b"".join(out)


def _encoded(documents: DataFrame, key: str, text: str, path: str | None, what: str, columns: str) -> DataFrame:
    ranks = load_ranks(path or vocabulary_path())
    kind = documents.schema[key].dataType.simpleString()
    head = {
        r["word"].encode("latin-1").decode(): struct.pack(f"<{len(r['ids'])}I", *r["ids"])
        for r in frequent(documents, text, ranks).toLocalIterator()
    }
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = rows.mapInArrow(coded(ranks, head, pattern(), what), f"key {kind}, n_tokens long, {columns}")
    return out.withColumnRenamed("key", key)


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """The key, n_tokens and ids of each row. path: the rank file, on the driver."""
    return _encoded(documents, key, text, path, "ids", "ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with the column ``decoded`` (binary): the pieces of the ids, one after another."""
    pieces = Pieces(load_ranks(path or vocabulary_path()))

    def run(batches):
        for batch in batches:
            text = [pieces.of(np.asarray(x.values)) if x.is_valid else None for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.binary())], [*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "decoded")
    return encoded.drop("decoded").mapInArrow(run, f"{schema}, decoded binary")


def digests(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """The key, n_tokens, ids_sha256 and decoded_sha256 of each row; ids and text stay in the worker."""
    return _encoded(documents, key, text, path, "digests", "ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_bpe": op3_bpe}
ORACLE_SQL: dict[str, str] = {}
