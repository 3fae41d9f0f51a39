"""Scalar functions on text, hashes, vectors and numbers, as Column expressions; the few that Spark's functions
cannot express are Arrow UDFs at the end."""

from __future__ import annotations

import unicodedata

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STOP_WORDS = ("the", "a", "an", "of", "to", "in", "is", "and", "or", "for", "how", "what", "where", "does", "do", "which")


def token_estimate(content: Column) -> Column:
    """max(1, characters div 3)."""
    return F.greatest(F.lit(1), F.floor(F.length(content) / 3)).cast("long")


def _plain() -> tuple[str, str]:
    """Latin letters with marks, and the same without."""
    points = [chr(i) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    plain = {c: "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)) for c in points}
    pairs = [(c, p) for c, p in plain.items() if p != c and len(p) == 1 and p.isascii()]
    return "".join(c for c, _ in pairs), "".join(p for _, p in pairs)


MARKED, PLAIN = _plain()


def document_terms(content: Column) -> Column:
    """Lower-cased runs of letters and digits without diacritics, repeats kept: the terms of the full-text index. Only a text
    that isn't ASCII is searched for marked characters."""
    plain = F.when(F.length(content) == F.octet_length(content), content).otherwise(F.translate(content, MARKED, PLAIN))
    return F.regexp_extract_all(F.lower(plain), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def camel_parts(token: Column) -> Column:
    """HTTPServerX2 -> HTTP, Server, X, 2."""
    spaced = F.regexp_replace(token, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.regexp_extract_all(spaced, F.lit(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), F.lit(0))


def _pieces(question: Column) -> Column:
    return F.filter(F.split(question, r"[^A-Za-z0-9_一-鿿]+"), lambda t: t != "")


def query_terms(question: Column) -> Column:
    """Distinct search terms in order: bigrams of a purely CJK token, else lower-cased camel-case parts, without stop
    words and single characters."""

    def split(t: Column) -> Column:
        cjk = t.rlike("^[一-鿿]+$")
        grams = F.when(F.length(t) > 1, F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array(t))
        return F.when(cjk, grams).otherwise(F.transform(camel_parts(t), F.lower))

    terms = F.flatten(F.transform(_pieces(question), split))
    kept = F.filter(terms, lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))
    return F.array_distinct(kept)


def identifiers(question: Column) -> Column:
    """Tokens of four characters or more that look like names of code: with an underscore, or of two camel-case parts or
    more with a capital first. Repeats are kept."""
    return F.filter(
        _pieces(question),
        lambda t: (F.length(t) >= 4) & (t.contains("_") | ((F.size(camel_parts(t)) >= 2) & t.rlike("^[A-Z]"))),
    )


def signature(line: Column) -> Column:
    """The trimmed line, at most 200 characters; null if nothing is left."""
    return F.nullif(F.substring(F.trim(line), 1, 200), F.lit(""))


def plain_type(name: Column) -> Column:
    """A type without arguments, array marks and package."""
    return F.substring_index(F.regexp_extract(name, r"^[^<\[]*", 0), ".", -1)


def method_owner(qualified: Column) -> Column:
    return F.nullif(F.regexp_extract(qualified, "^(.*)#[^#]*$", 1), F.lit(""))


def method_name(qualified: Column) -> Column:
    return F.regexp_extract(qualified, "([^#]*)$", 1)


def pretty_name(qualified: Column) -> Column:
    """Without the line that tells namesakes apart."""
    return F.regexp_replace(qualified, r"@\d+$", "")


def tail_name(pattern: Column) -> Column:
    """After the last dot, then after the last hash."""
    return F.substring_index(F.substring_index(pattern, ".", -1), "#", -1)


def argument_count(sig: Column) -> Column:
    """Commas outside nested brackets between the first opening and the last closing bracket, plus one; 0 if there is
    nothing between; null without brackets or if they do not match."""
    inner = F.regexp_extract(sig, r"(?s)\((.*)\)", 1)
    marks = F.split(F.regexp_replace(inner, r"[^()<>\[\],]", ""), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("commas"), F.lit(True).alias("good"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c.isin("(", "<", "["), 1).when(c.isin(")", ">", "]"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), (s["commas"] + F.when((c == ",") & (s["depth"] == 0), 1).otherwise(0)).alias("commas"), (s["good"] & (depth >= 0)).alias("good"))

    done = F.aggregate(marks, start, step)
    has = sig.rlike(r"(?s)\(.*\)") & done["good"] & (done["depth"] == 0)
    return F.when(has, F.when(F.trim(inner) == "", 0).otherwise(done["commas"] + 1)).cast("int")


def base_type(kind: Column) -> Column:
    """A column type's name in capitals, without what is in brackets."""
    return F.upper(F.trim(F.split_part(kind, F.lit("("), F.lit(1))))


def scrubbed_ddl(ddl: Column) -> Column:
    """Without vendor options of tables, and without the commas these leave before a closing bracket."""
    out = F.regexp_replace(ddl, r"(?i)\b(BLOCK_SIZE|LOCAL|GLOBAL|COMPRESSION|REPLICA_NUM|TABLET_SIZE|PCTFREE|USE_BLOOM_FILTER)\b\s*=?\s*('[^']*'|\d+)?", "")
    return F.regexp_replace(out, r",(\s*\))", "$1")


def clean_dynamic(body: Column) -> Column:
    """A mapper statement as SQL: parameters become '?', <where> and <set> their keywords; tags, comments go."""
    out = F.regexp_replace(body, r"[#$]\{[^}]*\}", "'?'")
    out = F.regexp_replace(out, r"(?i)<where\s*>", " WHERE 1=1 AND ")
    out = F.regexp_replace(out, r"(?i)<set\s*>", " SET ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    out = F.regexp_replace(out, r"--[^\n]*", " ")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    out = F.regexp_replace(out, r"(?i)\bWHERE 1=1 AND (AND|OR)\b", "WHERE 1=1 AND")
    out = F.regexp_replace(out, r"(?i)^(AND|OR) ", "")
    return F.regexp_replace(out, r"[,\s]+$", "")


def sql_shape(sql: Column) -> Column:
    """Literals as ? and 0, one space, lower case: what a fingerprint is the hash of."""
    out = F.regexp_replace(sql, r"'[^']*'", "?")
    out = F.regexp_replace(out, r"\b[0-9]+(\.[0-9]+)?\b", "0")
    return F.lower(F.trim(F.regexp_replace(out, r"\s+", " ")))


def sql_tables(sql: Column) -> Column:
    """Distinct lower-cased names after FROM, JOIN, INTO and UPDATE, without schema and quotes, sorted."""
    names = F.regexp_extract_all(F.lower(sql), F.lit(r"\b(?:from|join|into|update)\s+`?(?:[a-z0-9_]+`?\.`?)?([a-z_][a-z0-9_]*)"), F.lit(1))
    return F.array_sort(F.array_distinct(names))


def number(cell: Column) -> Column:
    """A number with thousands separators, else null."""
    return F.regexp_replace(F.trim(cell), ",", "").try_cast("double")


def similarity(distance: Column) -> Column:
    """Of a cosine distance: 0 from 1 on, one minus its size below 0, else one minus it."""
    return F.when(distance >= 1, F.lit(0.0)).when(distance < 0, 1 - F.abs(distance)).otherwise(1 - distance)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def usable_vector(v: Column, dim: int) -> Column:
    """Of the right dimension and finite."""
    return (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def line_of(text: Column, offset: Column) -> Column:
    """The 1-based line of a 0-based offset."""
    before = F.substring(text, F.lit(1), offset)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1).cast("int")


def truncated(text: Column, tokens: int = 32_000, marker: str = "\n... (truncated)") -> Column:
    """Cut at three characters a token, back to the last line end, with a marker."""
    head = F.substring(text, 1, tokens * 3)
    cut = F.when(F.instr(head, "\n") > 0, F.substring_index(head, "\n", -1)).otherwise(F.lit(""))
    kept = F.substring(head, F.lit(1), F.length(head) - F.length(cut) - F.when(F.instr(head, "\n") > 0, 1).otherwise(0))
    return F.when(F.length(text) > tokens * 3, F.concat(kept, F.lit(marker))).otherwise(text)


def control_share(head: Column) -> Column:
    """Share of control characters (but tab, line feed and carriage return); 0 for an empty text."""
    stripped = F.regexp_replace(head, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.when(F.length(head) == 0, F.lit(0.0)).otherwise((F.length(head) - F.length(stripped)) / F.length(head))


def is_binary(head: Column) -> Column:
    return control_share(head) > 0.10


LANGUAGES = {
    "java": "java", "py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "go": "go", "xml": "xml", "sql": "sql", "md": "markdown",
}


def language(path: Column) -> Column:
    """By extension; null if unknown."""
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


@F.pandas_udf(T.StringType())
def blake2b_hex(text: pd.Series) -> pd.Series:
    """128-bit BLAKE2b of a text or of bytes, in hexadecimal; null for null."""
    def one(t):
        return None if t is None else hashlib.blake2b(t if isinstance(t, bytes) else t.encode(), digest_size=16).hexdigest()

    return text.map(one)
