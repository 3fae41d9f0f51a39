"""URL filter: host and path rules, and a ratio of two character language models where no rule fits. Native.

Each rule blocks or allows a host with all its subdomains below a path; the longest rule that fits decides. URLs that
a rule decides are the training data of two Markov models over characters (accepted and rejected), with counts over
every such row. Orders 2, 1 and 0 are interpolated: the counts of a context decide how far the model relies on it, and
an unseen context falls back to the shorter one. A URL without a rule is allowed if its log-likelihood difference,
divided by its length, reaches the middle of the two classes' means.

All is SQL on the rows: characters become codes below ``A``, so a model is an array of A**3 log ratios at most (a bound
that no input moves), which the plan holds as a literal. Nothing is shuffled but the counts of A**3 keys.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule, and is scored on what text it
has (none: the two boundary marks alone). Without training rows of both kinds every ratio is of a uniform model.
Repeated rows give repeated results; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import literal, lower_az

#: (host, path, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./-?=_#:%&~"
EDGE = len(ALPHABET) + 1  # 0: any other character
A = len(ALPHABET) + 2
#: Weight of the shorter context in each interpolation.
BACK_OFF = 2.0
MICRO = 1_000_000


def host(url: Column) -> Column:
    return lower_az(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def by_rule(rules: tuple, what: int) -> Column:
    """Of the longest rule that fits the columns host and path: its text (0) or verdict (1); null if none fits."""
    out = F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        out = F.when(fits, F.lit((h + p, verdict)[what])).otherwise(out)
    return out


def ratios(counts: np.ndarray) -> np.ndarray:
    """Log ratio of accepted to rejected for each trigram, in whole millionths. counts: [2, A, A, A]."""
    logs = []
    for n3 in counts.astype(float):
        n2 = n3.sum(0)
        n1 = n2.sum(0)
        p0 = (n1 + 1) / (n1.sum() + A)
        p1 = (n2 + BACK_OFF * p0) / (n2.sum(1, keepdims=True) + BACK_OFF)
        logs.append(np.log((n3 + BACK_OFF * p1[None]) / (n3.sum(2, keepdims=True) + BACK_OFF)))
    return np.rint((logs[0] - logs[1]) * MICRO).astype(np.int64)


def filter_urls(pages: DataFrame, rules: tuple = RULES, url: str = "url", key: str = "page_id") -> DataFrame:
    """Each row's key, host, path, rule, verdict (allow or block) and score (log ratio a character)."""
    rows = pages.select(F.col(key), F.col(url).alias("__url"))
    rows = rows.withColumns({"host": host(F.col("__url")), "path": path(F.col("__url"))})
    rows = rows.withColumns({"rule": by_rule(rules, 0), "__ruled": by_rule(rules, 1)})
    rows = rows.withColumn("__s", lower_az(F.coalesce(F.col("__url"), F.lit("")))).withColumn(
        "__c",
        F.expr(
            f"concat(array({EDGE}, {EDGE}), transform(filter(split(__s, ''), x -> x <> ''),"
            f" x -> locate(x, '{ALPHABET}')), array({EDGE}))"
        ),
    )
    at = f"(__c[i] * {A} + __c[i + 1]) * {A} + __c[i + 2]"
    rows = rows.withColumn("__g", F.expr(f"transform(sequence(0, size(__c) - 3), i -> {at})"))
    known = rows.where(F.col("__ruled").isNotNull())
    grams = known.select(F.explode("__g").alias("g"), (F.col("__ruled") == "block").cast("long").alias("k"))
    counts = np.zeros((2, A**3))  # at most A**3 rows reach the driver
    for r in grams.groupBy("g").agg(F.sum(1 - F.col("k")).alias("a"), F.sum("k").alias("b")).collect():
        counts[:, r["g"]] = r["a"], r["b"]
    model = literal(json.dumps(ratios(counts.reshape(2, A, A, A)).ravel().tolist()), "array<bigint>")
    score = F.aggregate("__g", F.lit(0).cast("long"), lambda s, g: s + F.get(model, g))
    rows = rows.withColumn("score", score / F.size("__g") / MICRO)
    means = {r[0]: r[1] for r in rows.where(F.col("__ruled").isNotNull()).groupBy("__ruled").agg(F.avg("score")).collect()}
    middle = (means.get("allow", 0.0) + means.get("block", 0.0)) / 2
    judged = F.coalesce("__ruled", F.when(F.col("score") >= F.lit(middle), "allow").otherwise("block"))
    return rows.select(key, "host", "path", "rule", judged.alias("verdict"), "score")


#: The contract's rules, typed apart from RULES: a slip in either shows as a difference.
CONTRACT = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def _sql(rules: tuple = CONTRACT) -> str:
    """DuckDB SQL for op10_url_filter."""
    by_length = sorted(rules, key=lambda r: -len(r[0]) - len(r[1]))

    def case(what: int) -> str:
        arms = "".join(
            f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[what]}'"
            for h, p, v in by_length
        )
        return f"CASE{arms} END"

    side = lambda k: f"""
      n3{k} AS (SELECT a, b, c, count(*) AS n FROM grams WHERE ruled = '{k}' GROUP BY ALL),
      n2{k} AS (SELECT b, c, sum(n) AS n FROM n3{k} GROUP BY ALL),
      n1{k} AS (SELECT c, sum(n) AS n FROM n3{k} GROUP BY ALL),
      t3{k} AS (SELECT a, b, sum(n) AS n FROM n3{k} GROUP BY ALL),
      t2{k} AS (SELECT b, sum(n) AS n FROM n2{k} GROUP BY ALL),
      p{k} AS (SELECT g.a, g.b, g.c, ln((coalesce(n3.n, 0) + {BACK_OFF} *
          ((coalesce(n2.n, 0) + {BACK_OFF} * ((coalesce(n1.n, 0) + 1)::DOUBLE / (coalesce((SELECT sum(n) FROM n1{k}), 0) + {A})))
           / (coalesce(t2.n, 0) + {BACK_OFF}))) / (coalesce(t3.n, 0) + {BACK_OFF})) AS l
        FROM (SELECT DISTINCT a, b, c FROM grams) g
        LEFT JOIN n3{k} n3 USING (a, b, c) LEFT JOIN n2{k} n2 USING (b, c) LEFT JOIN n1{k} n1 USING (c)
        LEFT JOIN t3{k} t3 USING (a, b) LEFT JOIN t2{k} t2 USING (b))"""  # noqa: E731
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH h AS (SELECT row_number() OVER () AS rid, page_id, url,
        {low("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
      r AS (SELECT *, {case(0)} AS rule, {case(1)} AS ruled FROM h),
      k AS (SELECT *, [{EDGE}, {EDGE}] || list_transform(list_filter(string_split({low("coalesce(url, '')")}, ''), lambda x: x <> ''),
        lambda x: CAST(instr('{ALPHABET}', x) AS INTEGER)) || [{EDGE}] AS codes FROM r),
      grams AS (SELECT rid, ruled, codes[i] AS a, codes[i + 1] AS b, codes[i + 2] AS c
        FROM (SELECT rid, ruled, codes, unnest(range(1, len(codes) - 1)) AS i FROM k)),
      {side("allow")}, {side("block")},
      m AS (SELECT a, b, c, CAST(round(({MICRO}) * (pallow.l - pblock.l)) AS BIGINT) AS l FROM pallow JOIN pblock USING (a, b, c)),
      s AS (SELECT rid, sum(l)::DOUBLE / count(*) / {MICRO} AS score FROM grams JOIN m USING (a, b, c) GROUP BY rid),
      j AS (SELECT * FROM k JOIN s USING (rid)),
      t AS (SELECT (coalesce(avg(score) FILTER (WHERE ruled = 'allow'), 0) + coalesce(avg(score) FILTER (WHERE ruled = 'block'), 0)) / 2 AS middle FROM j)
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= middle THEN 'allow' ELSE 'block' END) AS verdict
    FROM j, t"""


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op10_url_filter": op10_url_filter}
ORACLE_SQL = {"op10_url_filter": _sql()}
