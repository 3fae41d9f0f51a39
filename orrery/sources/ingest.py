"""Files to tables: scan with ignore rules, parse, chunk; and the change set of a repository."""

from __future__ import annotations

import re
import subprocess

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.text import is_binary, language

MOST_BYTES = 1 << 20
CALL = "array<struct<caller:int,name:string,receiver:string,receiver_type:string,argc:int,kind:string,line:int,col:int,local:boolean>>"
SYMBOL = "array<struct<kind:string,name:string,qname:string,line_start:int,line_end:int,signature:string,parent:int,doc_start:int>>"
BINDING = "array<struct<name:string,source:string,kind:string,target:string>>"
PARSED = f"path string, language string, status string, package string, imports array<string>, symbols {SYMBOL}, bindings {BINDING}, calls {CALL}"


def wildcard(pattern: str) -> tuple[str, bool, bool] | None:
    """(regular expression over a path relative to the file's folder, negated, directories only) of an ignore line."""
    line = pattern.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    negated, line = line.startswith("!"), line.removeprefix("!")
    folder, line = line.endswith("/"), line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 1 :]:
            j = line.index("]", i + 1)
            out, i = out + "[" + line[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return ("^" if anchored else "(?:^|.*/)") + out + ("/.*$" if folder else "(?:/.*)?$"), negated, folder


def ignored(rel: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether a path is ignored. rules: (folder of the ignore file, line). In a file the last match decides; a match of any
    file ignores the path."""
    by_folder: dict[str, list] = {}
    for base, line in rules:
        if w := wildcard(line):
            by_folder.setdefault(base.strip("/"), []).append(w)
    out = F.lit(False)
    for base, patterns in by_folder.items():
        inside = rel.startswith(f"{base}/") if base else F.lit(True)
        own = F.substring(rel, len(base) + 2, 1 << 30) if base else rel
        hit = F.lit(False)
        for regex, negated, _ in patterns:
            hit = F.when(own.rlike(regex), F.lit(not negated)).otherwise(hit)
        out = out | (inside & hit)
    return out


def _hidden(spark: SparkSession, top: str) -> list[tuple]:
    """rel, content, size, mtime of files that Spark's readers leave out, because a part of their path begins with ``_`` or
    ``.``: package markers and ignore files. Only those of at most MOST_BYTES are read, one after another."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(top)
    fs = root.getFileSystem(conf)
    base = fs.makeQualified(root).toUri().getPath().rstrip("/")
    found, files = [], fs.listFiles(root, True)
    while files.hasNext():
        f = files.next()
        rel = f.getPath().toUri().getPath()[len(base) + 1 :]
        parts = rel.split("/")
        if ".git" not in parts and any(x[0] in "_." for x in parts) and f.getLen() <= MOST_BYTES:
            stream = fs.open(f.getPath())
            found.append((rel, bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)), f.getLen(), f.getModificationTime() / 1000))
            stream.close()
    return found


def scan(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """rel, content, size, mtime of a tree's files, without what ignore files and ``exclude`` leave out."""
    top = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(top)
    rel = F.regexp_replace("path", "^.*?" + re.escape(top.split("://")[-1].lstrip("/")) + "/", "")
    files = files.select(rel.alias("rel"), "content", F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"))
    hidden = _hidden(spark, top)
    rules = [("", line) for line in exclude or []]
    for path, content, _, _ in hidden:
        if path.rpartition("/")[2] == ".gitignore":
            rules += [(path.rpartition("/")[0], line) for line in content.decode("utf-8", "replace").split("\n")]
    others = [h for h in hidden if h[0].rpartition("/")[2] != ".gitignore"]
    files = files.unionByName(spark.createDataFrame(others, "rel string, content binary, size long, mtime double"))
    return files.where(~ignored(F.col("rel"), rules))


def readable(files: DataFrame) -> DataFrame:
    """Files of a known language, not over MOST_BYTES, not binary; with ``language``."""
    head = F.decode(F.substring("content", 1, 1024), "ISO-8859-1")
    return files.withColumn("language", language(F.col("rel"))).where(F.col("language").isNotNull() & (F.length("content") <= MOST_BYTES) & ~is_binary(head))


def parsed(files: DataFrame) -> DataFrame:
    """One row a file with its symbols, bindings and calls. files: rel, language, content."""

    def run(batches):
        from orrery.sources.parsers import parse

        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                rel, lang, content = (batch.column(k)[i].as_py() for k in range(3))
                rows.append({"path": rel, "language": lang} | parse(rel, lang, content or b""))
                size += len(content or b"")
                if size > MOST_BYTES:  # what is parsed takes many times its source's memory
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(PARSED))
    return files.select("rel", "language", "content").mapInArrow(run, PARSED)


def symbol_rows(parses: DataFrame) -> DataFrame:
    """id, file, idx and the fields of each symbol; ids are hashes of path and qualified name, so they never move."""
    out = parses.select("path", "language", F.posexplode("symbols").alias("idx", "s"))
    return out.select(F.xxhash64("path", "s.qname").alias("id"), F.col("path").alias("file"), "language", "idx", "s.*")


def contains_edges(symbols: DataFrame) -> DataFrame:
    """src, dst: each symbol from its parent, or from its module."""
    p = symbols.select("file", F.col("idx").alias("p"), F.col("id").alias("src"))
    c = symbols.where("idx > 0").select("file", F.coalesce("parent", F.lit(0)).alias("p"), F.col("id").alias("dst"))
    return c.join(p, ["file", "p"]).select("src", "dst")


def change_set(repo: str, base: str | None, known: dict[str, tuple[str, float]] | None = None) -> list[tuple[str, str]] | None:
    """(rel, status) by git: all files as A without a base; else the difference to it. None if git cannot say (no
    repository, changes that are not committed, unknown base): then :func:`orrery.operators.store.scan_changes` does."""

    def git(*args):
        return subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True)

    if git("rev-parse", "--git-dir").returncode or git("status", "--porcelain").stdout.strip():
        return None
    if base is None:
        return [(x, "A") for x in git("ls-files").stdout.split("\n") if x]
    if git("cat-file", "-e", f"{base}^{{commit}}").returncode:
        return None
    out = []
    for line in git("diff", "--name-status", f"{base}..HEAD").stdout.split("\n"):
        cells = line.split("\t")
        if len(cells) > 2 and cells[0][0] in "RC":
            out += [(cells[1], "D")] * (cells[0][0] == "R") + [(cells[2], "A")]
        elif len(cells) > 1:
            out.append((cells[1], cells[0][0] if cells[0][0] in "AD" else "M"))
    return out


WORD = re.compile(r"\S+")


def word_chunks(text: str, most: int, base_line: int = 1) -> list[dict]:
    """Greedy runs of words of at most ``most`` tokens (a third of the characters); a longer word is a chunk of its own."""
    out, first, last = [], None, None
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    import bisect

    def emit():
        if first is not None:
            out.append({"content": text[first:last], "line_start": base_line + bisect.bisect_left(breaks, first), "line_end": base_line + bisect.bisect_left(breaks, last)})

    for m in WORD.finditer(text):
        if first is not None and max(1, (m.end() - first) // 3) > most:
            emit()
            first = None
        if first is None:
            first = m.start()
        last = m.end()
    emit()
    return out


def code_chunks(text: str, symbols: list[dict], path: str, most: int) -> list[dict]:
    """A chunk for each function and method; for a class its documentation and declaration up to its first member; the whole
    file by words without any. Larger ones are cut by words; blank ones are left out."""
    lines = text.split("\n")
    own = [s for s in symbols if s["kind"] != "module"]
    spans = []
    for k, s in enumerate(symbols):
        if s["kind"] == "module":
            continue
        a, b = s["line_start"], s["line_end"]
        if s["kind"] in ("class", "interface"):
            a = s["doc_start"] or a
            inner = [c["line_start"] for c in symbols if c["parent"] == k]
            b = max(a, min(inner) - 1) if inner else b
        spans.append((s["qname"], a, b))
    if not own:
        spans = [(path, 1, len(lines))]
    out = []
    for title, a, b in spans:
        body = "\n".join(lines[a - 1 : b])
        if not body.strip():
            continue
        if own and max(1, len(body) // 3) <= most:
            out.append({"title": title, "content": body, "line_start": a, "line_end": b})
        else:
            out += [{"title": title} | c for c in word_chunks(body, most, a)]
    return out


def markdown_chunks(text: str, most: int) -> list[dict]:
    """Sections at ``## `` outside fences, with the preamble titled by its first line; larger ones cut by words."""
    sections, fence, lines = [[1, []]], False, text.split("\n")
    for n, line in enumerate(lines, 1):
        if line.lstrip().startswith(("```", "~~~")):
            fence = not fence
        elif line.startswith("## ") and not fence:
            sections.append([n, []])
        sections[-1][1].append(line)
    out = []
    for start, own in sections:
        body = "\n".join(own)
        if body.strip():
            title = next(x for x in own if x.strip()).lstrip("# ").strip()
            whole = {"title": title, "content": body, "line_start": start, "line_end": start + len(own) - 1}
            out += [whole] if max(1, len(body) // 3) <= most else [{"title": title} | c for c in word_chunks(body, most, start)]
    return out


CHUNKS = "file string, ord int, title string, content string, line_start int, line_end int"


def chunked(files: DataFrame, most: int = 512) -> DataFrame:
    """The chunks of each file; equal ones of a symbol once. files: rel, language, content."""

    def run(batches):
        from orrery.sources.parsers import parse

        for batch in batches:
            rows = []
            for rel, lang, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                text = (content or b"").decode("utf-8", "replace")
                found = markdown_chunks(text, most) if lang == "markdown" else code_chunks(text, parse(rel, lang, content or b"")["symbols"], rel, most)
                seen = set()
                for c in found:
                    if (c["title"], c["content"]) not in seen:
                        seen.add((c["title"], c["content"]))
                        rows.append({"file": rel, "ord": len(seen) - 1} | c)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = pa.schema([("file", pa.string()), ("ord", pa.int32()), ("title", pa.string()), ("content", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32())])
    return files.select("rel", "language", "content").mapInArrow(run, CHUNKS)
