"""Checks of generated pages: citations, coverage, diagrams, freshness, navigation; and sections of markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CITATION = r"\[([^\]\[]*)\](?:\(([^()\s:]+):(\d+)-(\d+)\))?"


def citations(pages: DataFrame) -> DataFrame:
    """page_id, path, a, b, raw of ``[text](path:A-B)`` and ``[path:A-B]`` in pages (page_id, content)."""
    both = []
    for pattern, path in ((r"(\[[^\]\[]*\]\(([^()\s:]+):(\d+)-(\d+)\))", 2), (r"(\[([^\]\[\s:]+):(\d+)-(\d+)\])(?!\()", 2)):
        get = lambda k, p=pattern: F.regexp_extract_all("content", F.lit(p), F.lit(k))
        zipped = F.explode(F.arrays_zip(get(path).alias("path"), get(3).alias("a"), get(4).alias("b"), get(1).alias("raw")))
        one = pages.select("page_id", zipped.alias("c"))
        both.append(one.select("page_id", "c.path", F.col("c.a").cast("int").alias("a"), F.col("c.b").cast("int").alias("b"), "c.raw"))
    return both[0].unionByName(both[1])


def checked_citations(cited: DataFrame, files: DataFrame) -> DataFrame:
    """Each citation with its verdict: ok, no file, or bad range. files: path, n_lines."""
    out = cited.join(files, "path", "left")
    good = (F.col("a") >= 1) & (F.col("a") <= F.col("b")) & (F.col("b") <= F.col("n_lines"))
    return out.withColumn("verdict", F.when(F.col("n_lines").isNull(), "no file").when(good, "ok").otherwise("bad range"))


def struck_out(pages: DataFrame, checked: DataFrame) -> DataFrame:
    """page_id, content with the bad citations (``raw``) struck through and marked."""
    bad = checked.where("verdict <> 'ok'").groupBy("page_id").agg(F.array_sort(F.collect_set("raw")).alias("bad"))
    mark = F.aggregate(F.coalesce("bad", F.array().cast("array<string>")), F.col("content"), lambda s, r: F.replace(s, r, F.concat(F.lit("~~"), r, F.lit("~~ (unverified)"))))
    return pages.join(bad, "page_id", "left").select("page_id", mark.alias("content"))


def coverage(pages: DataFrame, symbols: DataFrame) -> DataFrame:
    """page_id, coverage: the share of the page's class and interface names that occur in its text; 0 if it has none.
    pages: page_id, content; symbols: page_id, name."""
    seen = pages.join(symbols, "page_id", "left").groupBy("page_id")
    share = F.avg(F.when(F.col("name").isNull(), None).when(F.expr("instr(content, name)") > 0, 1.0).otherwise(0.0))
    return seen.agg(F.round(F.coalesce(share, F.lit(0.0)), 6).alias("coverage"))


def diagram_ok(block: Column) -> Column:
    """A diagram with ``graph TD``, an edge, and a label with a colon on each edge."""
    edges = F.filter(F.split(block, "\n"), lambda x: x.contains("-->"))
    return block.rlike(r"graph TD") & (F.size(edges) > 0) & ~F.exists(edges, lambda x: ~x.contains(":"))


def front_matter(content: Column) -> Column:
    """key: value lines between the first two ``---`` lines, as a map (empty if there are none)."""
    head = F.regexp_extract(content, r"(?s)^---\n(.*?)\n---\n", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    first = F.aggregate(pairs, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, p: F.when(F.exists(acc, lambda q: q["key"] == p["key"]), acc).otherwise(F.concat(acc, F.array(p))))
    return F.map_from_entries(first)


def stale(pages: DataFrame, modules: DataFrame) -> DataFrame:
    """page_id of pages whose module has another hash now, or is gone. pages: page_id, module, source_hash."""
    now = modules.select("module", F.col("source_hash").alias("now"))
    return pages.join(now, "module", "left").where(~F.col("source_hash").eqNullSafe(F.col("now"))).select("page_id", "module")


def write_target(pages: DataFrame, existing: DataFrame) -> DataFrame:
    """path, target: the page itself, or ``.suggested.md`` beside it if people edited it. pages: path; existing: path, body,
    body_hash (as written). Bodies are compared without outer white space."""
    edited = F.col("body").isNotNull() & (F.md5(F.trim("body")) != F.col("body_hash"))
    out = pages.join(existing, "path", "left")
    return out.select("path", F.when(edited, F.concat(F.regexp_replace("path", r"\.md$", ""), F.lit(".suggested.md"))).otherwise(F.col("path")).alias("target"))


def navigation(pages: DataFrame, group: str, order: str, title: str) -> DataFrame:
    """Each page with the title before and after it in its group."""
    w = Window.partitionBy(group).orderBy(order, title)
    return pages.withColumns({"prev": F.lag(title).over(w), "next": F.lead(title).over(w)})


def chapters(pages: DataFrame) -> DataFrame:
    """page, chapter, folder: NN-chapter in order of first appearance. pages: page, idx, chapter."""
    first = pages.groupBy("chapter").agg(F.min("idx").alias("first"))
    k = F.row_number().over(Window.orderBy("first", "chapter"))  # a plan has a few dozen chapters
    first = first.withColumn("folder", F.concat_ws("-", F.lpad(k.cast("string"), 2, "0"), "chapter"))
    return pages.join(first.select("chapter", "folder"), "chapter").select("page", "chapter", "folder")


def markdown_sections(lines: DataFrame) -> DataFrame:
    """doc, section (0: before the first heading), title, content, line_start, line_end. lines: doc, ord (from 1), line. A
    section starts at ``## `` outside fences; the preamble's title is its first line."""
    w = Window.partitionBy("doc").orderBy("ord")
    fence = F.col("line").rlike("^\\s*(```|~~~)").cast("int")
    inside = (F.sum(fence).over(w) - fence) % 2 == 1
    head = (F.col("line").startswith("## ") & ~inside & (fence == 0)).cast("int")
    marked = lines.withColumn("head", head).withColumn("section", F.sum("head").over(w))
    out = marked.groupBy("doc", "section").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("content"),
        F.min("ord").alias("line_start"),
        F.max("ord").alias("line_end"),
        F.min_by("line", "ord").alias("first"),
    )
    title = F.trim(F.regexp_replace("first", "^#+ ", ""))
    return out.where(F.trim("content") != "").select("doc", "section", title.alias("title"), "content", "line_start", "line_end")


def filled_headings(lines: DataFrame) -> DataFrame:
    """Each line with the last ``## `` heading at or above it."""
    w = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    title = F.when(F.col("line").startswith("## "), F.trim(F.expr("substring(line, 4)")))
    return lines.withColumn("heading", F.last(title, ignorenulls=True).over(w))


def fill_sheet(lines: DataFrame) -> DataFrame:
    """schema, table, row_count, data_mb of a markdown table under ``## schema`` headings; rows of other text are skipped."""
    own = filled_headings(lines).where(F.col("line").rlike(r"^\s*\|") & F.col("heading").isNotNull())
    cell = lambda k: F.trim(F.get(F.split("line", r"\|"), F.lit(k)))
    number = lambda c: F.regexp_replace(c, ",", "").try_cast("double")
    out = own.select(F.col("heading").alias("schema"), cell(1).alias("table"), number(cell(2)).alias("row_count"), number(cell(3)).alias("data_mb"))
    return out.where(~F.col("table").rlike("^(table|:?-+:?|)$"))


def interface_summary(symbols: DataFrame, limit: int = 40) -> DataFrame:
    """Interfaces first, then by qualified name."""
    return symbols.orderBy(F.when(F.col("kind") == "interface", 0).otherwise(1), "qname", "id").limit(limit)
