"""What a page's writer is given: its files under a budget of tokens, and the links of pages."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: str) -> int:
    return max(1, len(text) // 3)


def packed(files: list[tuple[str, str]], symbols: list[tuple], budget: int) -> tuple[str, int]:
    """(text, tokens) of one page. files: (path, content); symbols: (path, id, line_start, line_end, in_degree). A file that
    fits is whole; of another come its symbols by in-degree: whole with two callers or more, else their first line, and none
    that overlaps one before it."""
    out, used = [], 0
    for path, content in sorted(files):
        lines = content.splitlines()
        head = f"##### FILE: {path}\n"
        used += tokens(head)
        out.append(head)

        def numbered(a: int, b: int, lines=lines) -> str:
            return "\n".join(f"{i:>5}| {lines[i - 1]}" for i in range(a, min(b, len(lines)) + 1))

        if tokens("\n".join(lines)) <= budget - used:
            body = numbered(1, len(lines))
            out.append(f"[lines 1-{len(lines)}]\n{body}\n")
            used += tokens(body)
            continue
        shown: set[int] = set()
        own = sorted((s for s in symbols if s[0] == path), key=lambda s: (-s[4], s[1]))
        for _, _, a, b, callers in own:
            if shown.intersection(range(a, b + 1)):
                continue
            end = b if callers >= 2 else a
            body = numbered(a, end)
            if used + tokens(body) <= budget:
                out.append(f"[lines {a}-{min(end, len(lines))}]\n{body}\n")
                used += tokens(body)
                shown.update(range(a, min(end, len(lines)) + 1))
        if used >= budget:
            break
    return "\n".join(out), used


def pack(pages: DataFrame, files: DataFrame, symbols: DataFrame, in_degree: DataFrame, budget: int) -> DataFrame:
    """page_id, text, tokens. pages: page_id, path (a row for each file of the plan: a page has few); files: path, content;
    symbols: path, id, kind, line_start, line_end; in_degree: id, in_degree."""
    own = symbols.where(F.col("kind") != "module").join(in_degree, "id", "left")
    row = F.struct("path", "id", "line_start", "line_end", F.coalesce("in_degree", F.lit(0)).alias("n"))
    own = own.groupBy("path").agg(F.collect_list(row).alias("symbols"))
    each = pages.join(files, "path").join(own, "path", "left").groupBy("page_id")
    each = each.agg(F.collect_list(F.struct("path", "content")).alias("files"), F.flatten(F.collect_list(F.coalesce("symbols", F.array()))).alias("symbols"))

    def run(batches):
        import pandas as pd

        for frame in batches:
            done = [packed([(f["path"], f["content"]) for f in fs], [(s["path"], s["id"], s["line_start"], s["line_end"], s["n"]) for s in ss], budget) for fs, ss in zip(frame["files"], frame["symbols"], strict=True)]
            yield pd.DataFrame({"page_id": frame["page_id"], "text": [t for t, _ in done], "tokens": [n for _, n in done]})

    kind = pages.schema["page_id"].dataType.simpleString()
    return each.mapInPandas(run, f"page_id {kind}, text string, tokens long")


def by_in_degree(symbols: DataFrame, in_degree: DataFrame) -> DataFrame:
    """symbols with ``rank`` in their file: most callers first, ties by id. symbols: id, file_id."""
    from pyspark.sql import Window

    w = Window.partitionBy("file_id").orderBy(F.desc("in_degree"), "id")
    return symbols.join(in_degree, "id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0))).withColumn("rank", F.row_number().over(w))


def relative_link(target: str, page: str) -> str:
    """The link from one page to another, by their paths."""
    return posixpath.relpath(target, posixpath.dirname(page) or ".")


def file_links(content: Column, root: str, known: Column) -> Column:
    """Citations ``(path:A-B)`` of paths in ``known`` (an array) become ``(file://root/path)``."""
    found = F.array_distinct(F.regexp_extract_all(content, F.lit(r"\(([^)\s:]+):\d+-\d+\)"), F.lit(1)))
    quoted = lambda p: F.concat(F.lit(r"\(\Q"), p, F.lit(r"\E:\d+-\d+\)"))
    return F.aggregate(F.array_intersect(found, known), content, lambda s, p: F.regexp_replace(s, quoted(p), F.concat(F.lit(f"(file://{root}/"), F.replace(p, F.lit("$"), F.lit(r"\$")), F.lit(")"))))


def planned(plan: DataFrame, files: DataFrame) -> DataFrame:
    """The plan's pages with the files that exist; pages that lose all go. plan: page_id, files (array); files: path."""
    each = plan.select("page_id", F.posexplode("files").alias("at", "path")).join(files.select("path"), "path", "left_semi")
    kept = each.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "path"))), lambda x: x["path"]).alias("files"))
    return plan.drop("files").join(kept, "page_id")


def worth_planning(modules: DataFrame, least: int = 3) -> DataFrame:
    """module, files of the modules with ``least`` files or more. modules: module, path."""
    return modules.groupBy("module").agg(F.count("*").alias("files")).where(F.col("files") >= least)


def code_files(files: DataFrame) -> DataFrame:
    """The files that pages are about: parsed without error, of a suffix that has code or mappings. files: path, status."""
    return files.where((F.col("status") == "ok") & F.col("path").rlike(r"\.(java|ts|tsx|xml|js)$"))


def named(symbols: DataFrame) -> DataFrame:
    """Without sentinels, whose names begin with two underscores."""
    return symbols.where(~F.col("name").startswith("__"))


def doc_chunks(pages: DataFrame, kind: str) -> DataFrame:
    """kind, path, ord, title, content, content_hash of pages (path, content), a chunk for each section; suggestions and
    empty sections are left out. These replace the chunks of that kind."""
    from orrery.operators.docs import markdown_sections

    lines = pages.where(~F.col("path").endswith(".suggested.md")).select(F.col("path").alias("doc"), F.posexplode(F.split("content", "\n")).alias("i", "line"))
    out = markdown_sections(lines.select("doc", (F.col("i") + 1).alias("ord"), "line"))
    return out.select(F.lit(kind).alias("kind"), F.col("doc").alias("path"), F.col("section").alias("ord"), "title", "content", F.md5("content").alias("content_hash"), "line_start", "line_end")


def replace_kind(chunks: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    return chunks.where(F.col("kind") != kind).unionByName(new)


def human_docs(files: DataFrame) -> DataFrame:
    """The markdown files that people wrote, but for README.md. files: path, content."""
    return files.where(F.col("path").endswith(".md") & ~F.col("path").rlike(r"(^|/)README\.md$"))
