"""Audit rules of relational schemas.

tables: schema, table, row_count. columns: schema, table, column, is_pk, cardinality, top_share. indexes: schema, table,
index, columns (ordered array), is_unique, cardinality. accesses: fingerprint, location, table, column, usage, freq. Names
are lower case. A finding is: schema, table, rule_id, severity, evidence. Temporary tables are left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE = ["schema", "table"]


def lasting(tables: DataFrame) -> DataFrame:
    return tables.where(~F.lower("table").rlike("temp|tmp"))


def finding(df: DataFrame, rule: str, severity: Column | str, evidence: Column) -> DataFrame:
    kind = severity if isinstance(severity, Column) else F.lit(severity)
    return df.select(*TABLE, F.lit(rule).alias("rule_id"), kind.alias("severity"), evidence.alias("evidence"))


def indexed(indexes: DataFrame, columns: DataFrame) -> DataFrame:
    """The columns that some index or the primary key holds."""
    own = indexes.select(*TABLE, F.explode("columns").alias("column"))
    return own.unionByName(columns.where("is_pk").select(*TABLE, "column")).distinct()


def tbl001(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """No primary key."""
    bare = lasting(tables).join(columns.where("is_pk"), TABLE, "left_anti")
    return finding(bare, "TBL001", "high", F.lit("no primary key"))


def used(tables: DataFrame, columns: DataFrame, accesses: DataFrame, usage: str) -> DataFrame:
    """Accesses of one usage to known columns of lasting tables, with their schema."""
    known = columns.join(lasting(tables).select(*TABLE), TABLE, "left_semi").select(*TABLE, "column")
    return accesses.where(F.col("usage") == usage).join(known, ["table", "column"])


def idx001(tables: DataFrame, columns: DataFrame, indexes: DataFrame, accesses: DataFrame) -> DataFrame:
    """A WHERE column in no index; high if it is used more than twice."""
    bare = used(tables, columns, accesses, "where").join(indexed(indexes, columns), [*TABLE, "column"], "left_anti")
    per = bare.groupBy(*TABLE, "column").agg(
        F.sum(F.when(F.col("freq") != 0, F.col("freq")).otherwise(1)).alias("freq"), F.count_distinct("fingerprint").alias("queries"), F.slice(F.array_sort(F.collect_set("location")), 1, 3).alias("at")
    )
    evidence = F.concat_ws("|", "column", F.col("freq").cast("string"), F.col("queries").cast("string"), F.array_join("at", ","))
    return finding(per, "IDX001", F.when(F.col("freq") > 2, "high").otherwise("medium"), evidence)


def idx002(tables: DataFrame, columns: DataFrame, indexes: DataFrame, accesses: DataFrame) -> DataFrame:
    """A composite index of which a query uses some column but not the first."""
    sets = used(tables, columns, accesses, "where").groupBy("fingerprint", *TABLE).agg(F.array_sort(F.collect_set("column")).alias("used"))
    hit = sets.join(indexes.where(F.size("columns") >= 2), TABLE)
    hit = hit.where(F.arrays_overlap("used", "columns") & ~F.expr("array_contains(used, columns[0])"))
    hit = hit.select(*TABLE, "index", F.array_join("used", ",").alias("used")).distinct()
    return finding(hit, "IDX002", "medium", F.concat_ws("|", "index", "used"))


def idx003(tables: DataFrame, indexes: DataFrame) -> DataFrame:
    """An index that is a prefix of another of the same uniqueness."""
    own = indexes.join(lasting(tables).select(*TABLE), TABLE, "left_semi")
    more = own.select(*TABLE, "is_unique", F.col("index").alias("longer"), F.col("columns").alias("more"))
    pairs = own.join(more, [*TABLE, "is_unique"]).where("size(columns) < size(more) AND slice(more, 1, size(columns)) = columns")
    return finding(pairs, "IDX003", "low", F.concat_ws("|", "index", "longer"))


def idx004(tables: DataFrame, columns: DataFrame, indexes: DataFrame, accesses: DataFrame) -> DataFrame:
    """A JOIN column in no index."""
    bare = used(tables, columns, accesses, "join").join(indexed(indexes, columns), [*TABLE, "column"], "left_anti")
    bare = bare.select(*TABLE, "column", "fingerprint").distinct()
    return finding(bare, "IDX004", "medium", F.concat_ws("|", "column", "fingerprint"))


def idx005(tables: DataFrame, patterns: DataFrame) -> DataFrame:
    """Anti-patterns (table, column, kind, fingerprint) in queries on the schema's tables."""
    hit = patterns.join(lasting(tables).select(*TABLE), "table").select(*TABLE, "column", "kind", "fingerprint").distinct()
    return finding(hit, "IDX005", "medium", F.concat_ws("|", "column", "kind", "fingerprint"))


def idx101(tables: DataFrame, indexes: DataFrame) -> DataFrame:
    """Over four indexes on a table of under 5000 rows."""
    n = indexes.groupBy(*TABLE).agg(F.count("*").alias("n"))
    hit = lasting(tables).where("row_count < 5000").join(n, TABLE).where("n > 4")
    return finding(hit, "IDX101", "low", F.concat_ws("|", F.col("row_count").cast("string"), F.col("n").cast("string")))


def idx102(tables: DataFrame, indexes: DataFrame) -> DataFrame:
    """A single-column index that tells few rows apart (under a tenth as many values as rows)."""
    hit = indexes.where("size(columns) = 1 AND cardinality IS NOT NULL").join(lasting(tables), TABLE)
    hit = hit.where("row_count > 0 AND cardinality * 10 < row_count")
    return finding(hit, "IDX102", "medium", F.concat_ws("|", "index", F.col("cardinality").cast("string")))


def idx103(tables: DataFrame, columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """An indexed column of which one value fills over nine tenths."""
    hit = columns.where("top_share > 0.9").join(indexed(indexes, columns), [*TABLE, "column"], "left_semi")
    hit = hit.join(lasting(tables).select(*TABLE), TABLE, "left_semi")
    return finding(hit, "IDX103", "medium", F.concat_ws("|", "column", F.round("top_share", 4).cast("string")))


def qry101(slow: DataFrame) -> DataFrame:
    """Slow queries (schema, table, fingerprint, rows_scanned, rows_returned) that scan over 1000 rows for each one returned."""
    ratio = F.col("rows_scanned") / F.greatest(F.lit(1), "rows_returned")
    hit = slow.withColumn("ratio", ratio).where("ratio > 1000")
    return finding(hit, "QRY101", F.when(F.col("ratio") > 10000, "high").otherwise("medium"), F.concat_ws("|", "fingerprint", F.floor("ratio").cast("string")))


def run(tables: DataFrame, columns: DataFrame, indexes: DataFrame, accesses: DataFrame, patterns: DataFrame, slow: DataFrame) -> DataFrame:
    """The findings of all rules."""
    rules = [
        tbl001(tables, columns),
        idx001(tables, columns, indexes, accesses),
        idx002(tables, columns, indexes, accesses),
        idx003(tables, indexes),
        idx004(tables, columns, indexes, accesses),
        idx005(tables, patterns),
        idx101(tables, indexes),
        idx102(tables, indexes),
        idx103(tables, columns, indexes),
        qry101(slow),
    ]
    return reduce(DataFrame.unionByName, rules)


def unavailable(tables: DataFrame, indexes: DataFrame, columns: DataFrame, slow: DataFrame) -> DataFrame:
    """schema, rule_id of the rules that lack their statistics."""
    schemas = tables.select("schema").distinct()
    parts = []
    for rule, have in (
        ("IDX101", tables.where("row_count IS NOT NULL")),
        ("IDX102", indexes.where("cardinality IS NOT NULL")),
        ("IDX103", columns.where("top_share IS NOT NULL")),
        ("QRY101", slow),
    ):
        parts.append(schemas.join(have.select("schema").distinct(), "schema", "left_anti").select("schema", F.lit(rule).alias("rule_id")))
    return reduce(DataFrame.unionByName, parts)


def report(findings: DataFrame) -> str:
    """Markdown: by schema and rule, high ones first. A report is for people: findings are few beside the tables."""
    order = [F.col("schema"), F.col("rule_id"), (F.col("severity") != "high"), F.col("table")]
    out, schema, rule = ["# Schema audit"], None, None
    for r in findings.orderBy(*order).toLocalIterator():
        if r["schema"] != schema:
            schema, rule = r["schema"], None
            out.append(f"\n## {schema}")
        if r["rule_id"] != rule:
            rule = r["rule_id"]
            out.append(f"\n### {rule}")
        out.append(f"- [{r['severity']}] {r['table']}: {r['evidence']}")
    return "\n".join(out) + "\n"


def column_profile(rows: DataFrame, column: str, top: int = 10) -> DataFrame:
    """value, n, share of a column's most frequent values (ties to the smaller value)."""
    n = rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    out = n.crossJoin(F.broadcast(total)).select("value", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # one row
    return out.orderBy(F.desc("n"), "value").limit(top)


def suspects(columns: DataFrame, limit: int = 5) -> DataFrame:
    """Of each table, the first columns whose names hint at few values. columns: schema, table, column, is_pk, position."""
    from pyspark.sql import Window

    hint = F.lower("column").rlike("status|type|state|flag|kind|level|deleted") & ~F.col("is_pk")
    k = F.row_number().over(Window.partitionBy(*TABLE).orderBy("position"))
    return columns.where(hint).withColumn("k", k).where(F.col("k") <= limit).drop("k")


def profile_sql(schema: str, table: str, column: str) -> str:
    return f"SELECT {column}, COUNT(*) AS n FROM {schema}.{table} GROUP BY {column} ORDER BY n DESC LIMIT 10;"
