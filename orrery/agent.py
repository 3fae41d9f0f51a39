"""Read-only tools over an indexed repository, and a loop in which a model uses them.

The model is a function: it gets the messages so far and whether tools may be used, and returns either
``{"tool": name, "args": {...}}`` or ``{"answer": text}``. Endpoints are the caller's business."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from orrery import cli, store
from orrery.operators import graph

TURNS = 6
MOST_CHARS = 8000
#: Lines that an answer lists at most: a limit of the display, which says how many there are.
SHOWN = {"search": 20, "definition": 10, "ambiguous": 15, "edges": 50, "impact": 60}


class Tools:
    def __init__(self, spark: SparkSession, out: str, root: str | None = None):
        self.spark, self.out, self.root = spark, out, root
        self.calls: list[dict] = []

    def use(self, name: str, args: dict) -> str:
        """The result of a tool, as text; errors are texts too."""
        tools = {"search": self.search, "definition": self.definition, "callers": self.callers, "callees": self.callees, "impact": self.impact, "read_file": self.read_file}
        try:
            text = tools[name](**args) if name in tools else f"no such tool: {name}"
        except Exception as e:  # what a model asks for may be anything
            text = f"error: {e}"
        self.calls.append({"tool": name, "args": args, "chars": len(text)})
        return text if len(text) <= MOST_CHARS else f"{text[:MOST_CHARS]}\n... cut"

    def search(self, query: str) -> str:
        rows = cli.search(self.spark, self.out, query, SHOWN["search"])
        return "\n".join(f"{k}. [{r['file']}:{r['line_start']}-{r['line_end']}] {r['title'] or ''} ({r['score']:.4f}, {r['sources']})" for k, r in enumerate(rows, 1)) or "nothing found"

    def _hits(self, symbol: str):
        return graph.find_symbols(cli.symbols_of(self.spark, self.out), symbol)

    def definition(self, symbol: str) -> str:
        rows = self._hits(symbol).limit(SHOWN["definition"]).collect()
        return "\n".join(f"{r['kind']} {r['qname']} [{r['file']}:{r['line_start']}-{r['line_end']}] {r['signature'] or ''}" for r in rows) or "no such symbol"

    def _one(self, symbol: str):
        rows = self._hits(symbol).limit(SHOWN["ambiguous"]).collect()
        if len(rows) == 1:
            return rows[0], ""
        return None, "several symbols:\n" + "\n".join(r["qname"] for r in rows) if rows else "no such symbol"

    def _edges(self, symbol: str, way: str) -> str:
        one, why = self._one(symbol)
        if one is None:
            return why
        symbols = cli.symbols_of(self.spark, self.out)
        files = symbols.select("file_id", F.col("file").alias("path")).distinct()
        found = getattr(graph, way)(store.read(self.spark, self.out, "calls"), symbols, files, one["id"]).drop("src", "dst")
        rows = found.limit(SHOWN["edges"]).collect()
        return "\n".join(" ".join(str(v) for v in r) for r in rows) or f"no {way}"

    def callers(self, symbol: str) -> str:
        return self._edges(symbol, "callers")

    def callees(self, symbol: str) -> str:
        return self._edges(symbol, "callees")

    def impact(self, symbol: str, depth: int = 10) -> str:
        one, why = self._one(symbol)
        if one is None:
            return why
        symbols = cli.symbols_of(self.spark, self.out)
        found = graph.impact(store.read(self.spark, self.out, "calls"), self.spark.createDataFrame([(one["id"],)], "node long"), depth)
        found = found.join(symbols.select(F.col("id").alias("node"), "qname", "file"), "node")
        n = found.count()
        rows = found.orderBy("depth", "qname").limit(SHOWN["impact"]).collect()
        return "\n".join([f"{n} symbols", *(f"{r['depth']} {r['qname']} {r['file']}" for r in rows)])

    def read_file(self, path: str, start_line: int = 1, end_line: int = 200) -> str:
        """Lines of a file of the repository; only paths that the index has are read."""
        known = store.read(self.spark, self.out, "files").where(F.col("rel") == path)
        if self.root is None or known.isEmpty():
            return "no such file"
        text = self.spark.read.text(f"{self.root.rstrip('/')}/{path}", wholetext=True).first()
        lines = (text["value"] if text else "").splitlines()[max(1, start_line) - 1 : end_line]
        return "\n".join(f"{k:>5}| {line}" for k, line in enumerate(lines, max(1, start_line)))


def answer(question: str, tools: Tools, model: Callable[[list[dict], bool], dict], turns: int = TURNS) -> tuple[str, list[dict]]:
    """(answer, tool calls). After ``turns`` uses of tools the model has to answer without."""
    messages = [{"role": "user", "content": question}]
    for k in range(turns + 1):
        step = model(messages, k < turns)
        if "answer" in step or k == turns:
            return step.get("answer", ""), tools.calls
        messages += [{"role": "assistant", "content": step}, {"role": "tool", "content": tools.use(step["tool"], step.get("args", {}))}]
    return "", tools.calls


def written_pages(plan: list[dict], write: Callable[[dict, int], str], good: Callable[[dict, str], bool], retries: int = 2) -> list[dict]:
    """page, text, tries, fallback of a plan's pages. ``write`` gets the page and the number of the try; what is not ``good``
    (or an error) is tried again, and after that a page of its own title and files stands in."""
    out = []
    for page in plan:
        text, k = "", 0
        for k in range(retries + 1):
            try:
                text = write(page, k)
            except Exception:  # an endpoint's failure is a try
                text = ""
            if text and good(page, text):
                break
        else:
            files = "\n".join(f"- {f}" for f in page.get("files", []))
            text = f"# {page['title']}\n\n{files}\n"
            out.append({"page": page["page_id"], "text": text, "tries": k + 1, "fallback": True})
            continue
        out.append({"page": page["page_id"], "text": text, "tries": k + 1, "fallback": False})
    return out
