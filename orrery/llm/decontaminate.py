"""Benchmark decontamination by winnowing. Native: DataFrame and SQL functions only.

Texts become words; a fingerprint is the least hash of GRAM consecutive words in each run of ``WINDOW - GRAM + 1``
positions, so two texts that share WINDOW consecutive words share a fingerprint. The fingerprints of the documents are
joined with those of the benchmark; for the documents with a common one, every window of WINDOW words is compared with
the benchmark's windows as text, and each word of an equal window is hit. An item of fewer than WINDOW words is a window
of its own length, compared with all runs of that length in all documents, as no fingerprint is sure to lie in it.

Results are worked out per distinct text (its SHA-256), so copies cost one comparison and each row with that text gets
the same result. The benchmark's side is broadcast only if its counted rows are within BROADCAST_ROWS; beyond that
the joins shuffle.

Defined cases: a null or empty text, or one without words, has no words, no hits and is clean; null item texts have no
window; an item_id that repeats counts once; repeated documents repeat their result; empty tables give no rows or no hits;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import AZ, AZ_LOWER, small, written

WINDOW = 10
GRAM = 4
BROADCAST_ROWS = 1_000_000
#: Everything but letters, digits and non-ASCII characters parts words. A-Z are lower-cased afterwards, word by word.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words; an empty array for null."""
    low = lambda w: F.when(w.rlike("[A-Z]"), F.translate(w, AZ, AZ_LOWER)).otherwise(w)
    return F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK), ""), low)


def fingerprints(w: str, window: int = WINDOW, gram: int = GRAM) -> Column:
    """Distinct winnowed hashes of the word array in column ``w``; none if it has fewer than ``window`` words."""
    last = window - gram
    grams = ", ".join(f"get({w}, i + {j})" for j in range(1, gram))
    hashes = f"transform({w}, (x, i) -> xxhash64(x, {grams}))"
    width, step = 1, hashes
    while width < last + 1:  # least of 1, 2, 4 ... neighbours, then of exactly last + 1
        more = min(width, last + 1 - width)
        # a single-element transform binds the array, so that it is worked out once
        step = f"transform(array({step}), h{width} -> transform(h{width}, (x, i) -> least(x, get(h{width}, i + {more}))))[0]"
        width += more
    return F.expr(f"CASE WHEN size({w}) >= {window} THEN array_distinct(slice({step}, 1, size({w}) - {window - 1})) ELSE array() END")


def windows(w: str, n: int) -> Column:
    """(start, text) of each run of ``n`` words in column ``w``."""
    return F.expr(
        f"CASE WHEN size({w}) >= {n} THEN transform(sequence(0, size({w}) - {n}), "
        f"i -> struct(i AS start, array_join(slice({w}, i + 1, {n}), ' ') AS key)) END"
    )


def contamination(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """Of each distinct text with a hit: __key, n_hit, item_ids (sorted strings), spans (array of start, n words)."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(WINDOW))
    each = F.expr(
        f"transform(sequence(0, size(w) - least(size(w), {WINDOW})), i -> array_join(slice(w, i + 1, {WINDOW}), ' '))"
    )
    item_windows = written(
        items.select("item", n.alias("n"), F.explode(each).alias("key")).distinct(), "benchmark-windows"
    )
    keys = written(item_windows.select("key", "n").distinct(), "benchmark-keys")
    n_keys = keys.groupBy("n").count().collect()  # at most WINDOW rows
    sizes, total = sorted(r["n"] for r in n_keys), sum(r["count"] for r in n_keys)
    docs = documents.select(text_key(F.col(text)).alias("__key"), words(F.col(text)).alias("w"))
    hits = None
    for size in sizes:
        some = docs
        if size == WINDOW:
            long_items = items.where(F.size("w") >= WINDOW)
            marks = written(long_items.select(F.explode(fingerprints("w")).alias("f")).distinct(), "benchmark-marks")
            marks_small = small(marks, marks.count(), BROADCAST_ROWS)
            met = docs.select("__key", F.explode(fingerprints("w")).alias("f")).join(marks_small, "f", "left_semi")
            met = written(met.select("__key").distinct(), "met")
            some = docs.join(small(met, met.count(), BROADCAST_ROWS), "__key", "left_semi")
        found = some.select("__key", F.explode(windows("w", size)).alias("x")).select("__key", "x.start", "x.key")
        found = found.join(small(keys.where(F.col("n") == size), total, BROADCAST_ROWS), "key")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:  # no item has a word
        hits = docs.select("__key", F.lit(0).alias("start"), F.lit("").alias("key"), F.lit(0).alias("n")).limit(0)
    hits = written(hits.select("__key", "start", "n", "key").distinct(), "hits")
    spans = hits.groupBy("__key").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    covered = F.expr("size(array_distinct(flatten(transform(spans, s -> sequence(s.start, s.start + s.n - 1)))))")
    named = hits.select("__key", "key").distinct().join(small(item_windows, item_windows.count(), BROADCAST_ROWS), "key")
    named = named.groupBy("__key").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    return spans.join(named, "__key").select("__key", covered.cast("long").alias("n_hit"), "item_ids", "spans")


def text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def decontaminate(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each document: its key, n_words, n_hit, n_items, item_ids (sorted, comma-joined), contaminated."""
    found = contamination(documents, benchmark, text)
    docs = documents.select(
        F.col(key), text_key(F.col(text)).alias("__key"), F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BREAK), "")).cast("long").alias("n_words")
    )
    out = docs.join(found, "__key", "left")
    return out.select(
        key,
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.greatest(F.coalesce(F.size("item_ids"), F.lit(0)), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join("item_ids", ","), F.lit("")).alias("item_ids"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents without any hit, with all their columns."""
    found = contamination(documents, benchmark, text).select("__key")
    return documents.withColumn("__key", text_key(F.col(text))).join(found, "__key", "left_anti").select(*documents.columns)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  b AS (SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
  dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
    FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
  hit AS (SELECT rid, i, dw.n, item FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
  pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid),
  its AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    out = decontaminate(read("documents"), read("benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.col("item_ids"), 256).alias("items_sha256"), "contaminated"
    )


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLE_SQL = {"op4_decontaminate": SQL}
