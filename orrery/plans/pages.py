"""Queries on generated pages and markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import docs
from orrery.plans import views as V
from orrery.session import table

PAGES = """SELECT * FROM (VALUES (1, 'See [Order](src/order.py:1-5) and [src/user.py:3-9]. Class Order, UserRepo.'), (2, '[gone](src/none.py:1-2) [src/order.py:90-95] [src/order.py:7-3]'), (3, 'nothing')) AS t(page_id, content)"""
CITED = """SELECT * FROM (VALUES (1, 'src/order.py', 1, 5, '[Order](src/order.py:1-5)'), (1, 'src/user.py', 3, 9, '[src/user.py:3-9]'), (2, 'src/none.py', 1, 2, '[gone](src/none.py:1-2)'),
  (2, 'src/order.py', 90, 95, '[src/order.py:90-95]'), (2, 'src/order.py', 7, 3, '[src/order.py:7-3]')) AS t(page_id, path, a, b, raw)"""
SOURCE = """SELECT * FROM (VALUES ('src/order.py', 20), ('src/user.py', 9)) AS t(path, n_lines)"""
PAGE_SYMBOLS = """SELECT * FROM (VALUES (1, 'Order'), (1, 'UserRepo'), (1, 'Missing'), (2, 'Order')) AS t(page_id, name)"""
LINES = """SELECT * FROM (VALUES (1, 1, 'Intro'), (1, 2, 'text'), (1, 3, '## First'), (1, 4, '{f}'), (1, 5, '## not a heading'), (1, 6, '{f}'), (1, 7, 'x'), (1, 8, '## Second'), (2, 1, '## Only'), (2, 2, ''), (3, 1, ' '), (3, 2, 'plain'))
  AS t(doc, ord, line)""".replace("{f}", "```")
SHEET = """SELECT * FROM (VALUES (1, 1, '# fill'), (1, 2, '## shop'), (1, 3, '| table | row_count | data_mb |'), (1, 4, '|---|---|---|'), (1, 5, '| t_order | 1,200 | 3.5 |'), (1, 6, '| t_item | | x |'), (1, 7, '## crm'), (1, 8, '| t_user | 7 | 0 |')) AS t(doc, ord, line)"""
OLD = """SELECT * FROM (VALUES (1, 'a', 'h1'), (2, 'b', 'h2'), (3, 'gone', 'h3')) AS t(page_id, module, source_hash)"""
NOW = """SELECT * FROM (VALUES ('a', 'h1'), ('b', 'other')) AS t(module, source_hash)"""
CHAPTER_PAGES = """SELECT * FROM (VALUES ('p1', 0, 'start'), ('p2', 1, 'deep'), ('p3', 2, 'start'), ('p4', 3, 'end')) AS t(page, idx, chapter)"""

CATALOG = {
    "citations": (lambda s, sf: docs.citations(V.values(s, PAGES)), CITED),
    "citation_validate": (
        lambda s, sf: docs.checked_citations(docs.citations(V.values(s, PAGES)), V.values(s, SOURCE)).select("page_id", "raw", "verdict"),
        f"SELECT page_id, raw, CASE WHEN n_lines IS NULL THEN 'no file' WHEN a >= 1 AND a <= b AND b <= n_lines THEN 'ok' ELSE 'bad range' END AS verdict FROM ({CITED}) LEFT JOIN ({SOURCE}) USING (path)",
    ),
    "citation_strike": (
        lambda s, sf: docs.struck_out(V.values(s, PAGES), docs.checked_citations(docs.citations(V.values(s, PAGES)), V.values(s, SOURCE))),
        f"""SELECT page_id, CASE WHEN page_id = 2 THEN '~~[gone](src/none.py:1-2)~~ (unverified) ~~[src/order.py:90-95]~~ (unverified) ~~[src/order.py:7-3]~~ (unverified)' ELSE content END AS content FROM ({PAGES})""",
    ),
    "symbol_coverage": (
        lambda s, sf: docs.coverage(V.values(s, PAGES), V.values(s, PAGE_SYMBOLS)),
        f"SELECT page_id, round(coalesce(avg(CASE WHEN name IS NULL THEN NULL WHEN contains(content, name) THEN 1.0 ELSE 0.0 END), 0), 6) AS coverage FROM ({PAGES}) LEFT JOIN ({PAGE_SYMBOLS}) USING (page_id) GROUP BY page_id",
    ),
    "interface_summary": (lambda s, sf: docs.interface_summary(V.symbols(s, sf)).select("id", "qname"), f"SELECT id, qname FROM ({V.SYMBOLS}) ORDER BY CASE WHEN kind = 'interface' THEN 0 ELSE 1 END, qname, id LIMIT 40"),
    "nav_prev_next": (
        lambda s, sf: docs.navigation(table(s, sf, "conversations").select("conv_id", "turn", F.md5("text").alias("title")), "conv_id", "turn", "title"),
        "SELECT conv_id, turn, title, lag(title) OVER w AS prev, lead(title) OVER w AS next FROM (SELECT conv_id, turn, md5(text) AS title FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn, title)",
    ),
    "markdown_sections": (
        lambda s, sf: docs.markdown_sections(V.values(s, LINES)).select("doc", "title", F.md5("content").alias("content"), "line_start", "line_end"),
        """SELECT doc, title, md5(content) AS content, line_start, line_end FROM (VALUES (1, 'Intro', 'Intro' || chr(10) || 'text', 1, 2), (1, 'First', '## First' || chr(10) || '```' || chr(10) || '## not a heading' || chr(10) || '```' || chr(10) || 'x', 3, 7),
        (1, 'Second', '## Second', 8, 8), (2, 'Only', '## Only' || chr(10), 1, 2), (3, '', ' ' || chr(10) || 'plain', 1, 2)) AS t(doc, title, content, line_start, line_end)""",
    ),
    "heading_fill": (
        lambda s, sf: docs.filled_headings(V.values(s, LINES)).select("doc", "ord", "heading"),
        f"SELECT doc, ord, last_value(CASE WHEN starts_with(line, '## ') THEN trim(line[4:]) END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING) AS heading FROM ({LINES})",
    ),
    "fill_sheet": (lambda s, sf: docs.fill_sheet(V.values(s, SHEET)), """SELECT * FROM (VALUES ('shop', 't_order', 1200.0::DOUBLE, 3.5::DOUBLE), ('shop', 't_item', NULL, NULL), ('crm', 't_user', 7, 0)) AS t(schema, "table", row_count, data_mb)"""),
    "stale_pages": (lambda s, sf: docs.stale(V.values(s, OLD), V.values(s, NOW)), f"SELECT page_id, o.module FROM ({OLD}) o LEFT JOIN ({NOW}) n USING (module) WHERE o.source_hash IS DISTINCT FROM n.source_hash"),
    "chapter_folders": (
        lambda s, sf: docs.chapters(V.values(s, CHAPTER_PAGES)),
        "SELECT * FROM (VALUES ('p1', 'start', '01-start'), ('p2', 'deep', '02-deep'), ('p3', 'start', '01-start'), ('p4', 'end', '03-end')) AS t(page, chapter, folder)",
    ),
}
