"""Schemas and their statistics as tables: definitions of a folder, profiles, fill sheets, slow queries, findings.

tables: schema, table, row_count, data_length. columns: schema, table, column, ..., cardinality, null_ratio, top_share.
indexes: schema, table, index, columns, is_unique, cardinality."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.text import sql_tables

TABLE = ["schema", "table"]
PROFILE = (
    "schema string, tables map<string, struct<row_count: bigint, data_length: bigint, index_length: bigint, auto_inc_value: bigint,"
    " index_cardinality: map<string, bigint>, column_stats: map<string, struct<cardinality: bigint, null_ratio: double,"
    " top_values: array<struct<v: string, n: bigint>>>>>>, slow_queries array<struct<schema: string, sql: string, freq: double,"
    " avg_ms: double, rows_scanned: double, rows_returned: double>>"
)
DDL = (
    "tables array<struct<name: string, columns: array<struct<name: string, type: string, nullable: boolean, is_pk: boolean>>,"
    " indexes: array<struct<name: string, columns: array<string>, is_unique: boolean>>>>, failures array<string>"
)


def ddl_folder(spark: SparkSession, folder: str) -> DataFrame:
    """schema, tables, failures of each ``.sql`` and ``.md`` file; the file's stem is the schema, and a ``.md`` file replaces
    a ``.sql`` file of the same stem."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf(DDL)
    def parse(texts, markdown):
        import pandas as pd

        from orrery.sources import schemas

        return pd.DataFrame([schemas.parse_ddl(schemas.ddl_text(t, m)) for t, m in zip(texts, markdown, strict=True)])

    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=False, pathGlobFilter="*.{sql,md}")
    files = files.withColumn("name", F.regexp_extract(F.input_file_name(), "([^/]*)$", 1))
    stem, markdown = F.regexp_replace("name", r"\.(sql|md)$", ""), F.col("name").endswith(".md")
    files = files.select(stem.alias("schema"), markdown.alias("markdown"), "value")
    last = files.groupBy("schema").agg(F.max_by("value", "markdown").alias("value"), F.max("markdown").alias("markdown"))
    return last.select("schema", parse("value", "markdown").alias("d")).select("schema", "d.*")


def definitions(parsed: DataFrame) -> dict[str, DataFrame]:
    """tables, columns and indexes of ``ddl_folder``'s rows; statistics are null until a profile gives them."""
    each = parsed.select("schema", F.explode("tables").alias("t"))
    none = lambda kind: F.lit(None).cast(kind)
    columns = each.select("schema", F.col("t.name").alias("table"), F.posexplode("t.columns").alias("position", "c"))
    indexes = each.select("schema", F.col("t.name").alias("table"), F.explode("t.indexes").alias("i"))
    return {
        "tables": each.select("schema", F.col("t.name").alias("table"), none("long").alias("row_count"), none("long").alias("data_length")),
        "columns": columns.select(
            *TABLE, F.col("c.name").alias("column"), F.col("c.type").alias("type"), F.col("c.is_pk").alias("is_pk"), "position",
            none("long").alias("cardinality"), none("double").alias("null_ratio"), none("double").alias("top_share"),
        ),
        "indexes": indexes.select(*TABLE, F.col("i.name").alias("index"), F.col("i.columns").alias("columns"), F.col("i.is_unique").alias("is_unique"), none("long").alias("cardinality")),
    }


def persisted(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``existing`` with all rows of the schemas in ``new`` replaced."""
    return existing.join(new.select("schema").distinct(), "schema", "left_anti").unionByName(new)


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """The profiles of a file or folder of JSON."""
    return spark.read.schema(PROFILE).json(path, multiLine=True)


def applied(tables: DataFrame, columns: DataFrame, indexes: DataFrame, given: DataFrame) -> dict[str, DataFrame]:
    """The tables with a profile's statistics. Those of a table replace what is there, also by null; those of indexes and
    columns only where they are given."""
    each = given.select("schema", F.explode("tables").alias("table", "p"))
    stats = each.select(*TABLE, F.col("p.row_count").alias("r"), F.col("p.data_length").alias("d"), F.lit(True).alias("given"))
    pick = lambda new, old: F.when(F.col("given"), F.col(new)).otherwise(F.col(old)).alias(old)
    out = {"tables": tables.join(stats, TABLE, "left").select(*TABLE, pick("r", "row_count"), pick("d", "data_length"))}
    card = each.select(*TABLE, F.explode("p.index_cardinality").alias("index", "n"))
    out["indexes"] = indexes.join(card, [*TABLE, "index"], "left").withColumn("cardinality", F.coalesce("n", "cardinality")).drop("n").select(indexes.columns)
    stat = each.select(*TABLE, F.col("p.row_count").alias("rows"), F.explode("p.column_stats").alias("column", "s"))
    top = F.array_max(F.transform("s.top_values", lambda v: v["n"]))
    stat = stat.select(*TABLE, "column", F.col("s.cardinality").alias("n"), F.col("s.null_ratio").alias("z"), F.try_divide(top, F.col("rows")).alias("share"))
    joined = columns.join(stat, [*TABLE, "column"], "left")
    for new, old in (("n", "cardinality"), ("z", "null_ratio"), ("share", "top_share")):
        joined = joined.withColumn(old, F.coalesce(new, old))
    out["columns"] = joined.select(columns.columns)
    return out


def column_stats(rows: DataFrame, names: list[str], top: int = 10) -> DataFrame:
    """column, cardinality, null_ratio, top_values (v, n; ties to the smaller value) of columns of ``rows``: two passes, and
    no value of a row leaves the cluster but the top ones."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in names))).alias("x")).select("x.*")
    n = long.groupBy("column", "v").agg(F.count("*").alias("n"))
    per = n.groupBy("column").agg(F.count("v").alias("cardinality"), F.round(F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("null_ratio"))
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "v"))
    best = n.where(F.col("v").isNotNull()).withColumn("k", k).where(F.col("k") <= top)
    values = F.transform(F.array_sort(F.collect_list(F.struct("k", "v", "n"))), lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n")))
    return per.join(best.groupBy("column").agg(values.alias("top_values")), "column", "left")


def lasting(name: Column) -> Column:
    return ~F.lower(name).rlike("temp|tmp")


def template(schema: str, tables: list[str]) -> str:
    """A profile of nulls to fill in, without temporary tables."""
    none = dict.fromkeys(("row_count", "data_length", "index_length", "auto_inc_value"))
    own = {t: none | {"index_cardinality": {}, "column_stats": {}} for t in sorted(tables) if not any(x in t.lower() for x in ("temp", "tmp"))}
    return json.dumps({"schema": schema, "tables": own, "slow_queries": []}, ensure_ascii=False, indent=2) + "\n"


def sheet(tables: DataFrame) -> str:
    """A fill sheet in markdown: a section for each schema, a row for each lasting table. For people: a row for each table."""
    out, schema = ["# Fill sheet"], None
    for r in tables.where(lasting(F.col("table"))).orderBy(*TABLE).toLocalIterator():
        if r["schema"] != schema:
            schema = r["schema"]
            out += [f"\n## {schema}\n", "| table | row_count | data_mb | index_mb | auto_inc | note |", "|---|---|---|---|---|---|"]
        out.append(f"| {r['table']} | | | | | |")
    return "\n".join(out) + "\n"


def slow_by_schema(slow: DataFrame, tables: DataFrame, default: str | None = None) -> DataFrame:
    """The slow queries with their schema: the own, else the default, else the only one that has a table they name; the rest,
    and those of unknown schemas, go. slow: schema, sql, ..."""
    slow = slow.withColumn("__id", F.xxhash64(*slow.columns))
    named = slow.select("__id", F.explode(sql_tables(F.col("sql"))).alias("table"))
    hit = named.join(tables.select("schema", F.lower("table").alias("table")), "table").groupBy("__id")
    hit = hit.agg(F.min("schema").alias("__only"), F.count_distinct("schema").alias("__n")).where("__n = 1").drop("__n")
    out = slow.join(hit, "__id", "left").withColumn("schema", F.coalesce(F.nullif("schema", F.lit("")), F.lit(default), "__only")).drop("__id", "__only")
    return out.join(tables.select("schema").distinct(), "schema", "left_semi").select(slow.drop("__id").columns)


def merged_slow(existing: DataFrame, offered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all, counts): the slow queries of both, equal ones once, and schema, offered: how many were offered, new or not."""
    return existing.unionByName(offered).dropDuplicates(), offered.groupBy("schema").agg(F.count("*").alias("offered"))


def stored_findings(findings: DataFrame) -> DataFrame:
    """table (as schema.table), rule_id, severity, evidence as JSON; these replace what was stored."""
    evidence = F.to_json(F.struct(F.split("evidence", r"\|").alias("parts")))
    return findings.select(F.concat_ws(".", *TABLE).alias("table"), "rule_id", "severity", evidence.alias("evidence"))
