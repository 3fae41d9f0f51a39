"""Source files to symbols, imports and call sites.

Python is read with the standard library's ``ast``. Java, TypeScript/JavaScript and Go are read from tokens: a scanner drops
comments and literals, pairs brackets, and a walk over the pairs finds declarations and calls. A file that cannot be read
yields its module symbol alone. Lines and columns count from 1.

A symbol is a dict: kind, name, qname, line_start, line_end, signature, parent (index of a symbol, or None), doc_start. A
call is: caller (index or None), name, receiver, receiver_type, argc, kind (call, new), line, col, local. A binding is: name,
source, kind (named, class, module, default), target."""

from __future__ import annotations

import ast
import bisect
import heapq
import re

TOKEN = re.compile(
    r"(?P<doc>/\*.*?(?:\*/|$))|(?P<note>//[^\n]*)|(?P<text>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)"
    r"|(?P<word>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|\?\.|::|->|\.\.\.|[^\s\w])",
    re.S,
)
OPEN, CLOSE = {"(": ")", "{": "}", "[": "]"}, {")", "}", "]"}
NOT_CALLS = frozenset("if for while switch catch synchronized return throw new else do try assert case typeof instanceof await yield function super this func go defer select range import".split())


class Source:
    """Tokens of a brace language, with the partner of each bracket."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.kind, self.text, self.line, self.col, self.docs = [], [], [], [], {}
        starts, at = [0], 0
        for x in self.lines:
            at += len(x) + 1
            starts.append(at)
        row, doc = 0, None
        for m in TOKEN.finditer(text):
            while m.start() >= starts[row + 1]:
                row += 1
            if m.lastgroup == "note":
                continue
            if m.lastgroup == "doc":
                doc = (row + 1, row + 1 + m.group().count("\n"), m.group())
                continue
            if doc:
                self.docs[len(self.text)] = doc
                doc = None
            self.kind.append(m.lastgroup)
            self.text.append(m.group())
            self.line.append(row + 1)
            self.col.append(m.start() - starts[row] + 1)
        self.pair, stack = {}, []
        for i, t in enumerate(self.text):
            if self.kind[i] != "mark":
                continue
            if t in OPEN:
                stack.append(i)
            elif t in CLOSE and stack and OPEN[self.text[stack[-1]]] == t:
                j = stack.pop()
                self.pair[j], self.pair[i] = i, j
        self.n = len(self.text)

    def is_word(self, i: int) -> bool:
        return 0 <= i < self.n and self.kind[i] == "word"

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < self.n and self.kind[i] != "text" else ""

    def skip_types(self, i: int) -> int:
        """Past ``<...>`` at i, if it looks like type arguments."""
        if self.at(i) != "<":
            return i
        depth, j = 0, i
        while j < self.n and j < i + 200:
            t = self.at(j)
            depth += (t == "<") - (t == ">")
            if depth == 0:
                return j + 1
            if t in ("{", "}", ";", "&&", "("):
                return i
            j += 1
        return i

    def argc(self, i: int) -> int | None:
        """Arguments between the bracket at i and its partner."""
        end = self.pair.get(i)
        if end is None:
            return None
        n, j = 0, i + 1
        seen = False
        while j < end:
            t = self.at(j)
            if self.kind[j] == "mark" and t in OPEN and j in self.pair:
                j = self.pair[j]
                seen = True
            elif t == ",":
                n += 1
            elif t == "<" and self.skip_types(j) > j:
                j = self.skip_types(j) - 1
            else:
                seen = True
            j += 1
        return n + 1 if seen else 0


class Found:
    def __init__(self, rel: str, language: str, lines: list[str]):
        self.lines, self.calls, self.imports, self.bindings, self.package = lines, [], [], [], None
        self.symbols = [{"kind": "module", "name": rel.rsplit("/", 1)[-1], "qname": rel, "line_start": 1, "line_end": max(1, len(lines)), "signature": None, "parent": None, "doc_start": None}]

    def add(self, kind, name, qname, first, last, parent, doc=None) -> int:
        line = (self.lines[first - 1].strip()[:200] or None) if 0 < first <= len(self.lines) else None
        self.symbols.append({"kind": kind, "name": name, "qname": qname, "line_start": first, "line_end": last, "signature": line, "parent": parent, "doc_start": doc})
        return len(self.symbols) - 1

    def call(self, caller, name, receiver, kind_of, argc, kind, line, col, local=False):
        self.calls.append({"caller": caller, "name": name, "receiver": receiver, "receiver_type": kind_of, "argc": argc, "kind": kind, "line": line, "col": col, "local": local})

    def bind(self, name, source, kind, target=None):
        self.bindings.append({"name": name, "source": source, "kind": kind, "target": target})

    def result(self) -> dict:
        seen = set()
        for s in self.symbols:
            if s["qname"] in seen:
                s["qname"] = f"{s['qname']}@{s['line_start']}"
            seen.add(s["qname"])
        return {"symbols": self.symbols, "imports": self.imports, "bindings": self.bindings, "calls": self.calls, "package": self.package}


def plain(type_text: str) -> str:
    return re.split(r"[<\[]", type_text.strip())[0].strip().rsplit(".", 1)[-1]


def _receiver(s: Source, i: int) -> tuple[str | None, int]:
    """The text before the dot that stands at i - 1, if any, and its first token."""
    if s.at(i - 1) not in (".", "?."):
        return None, i
    j = i - 2
    if s.at(j) in (")", "]") and j in s.pair:
        j = s.pair[j]
        j = j - 1 if s.is_word(j - 1) else j
    while s.at(j - 1) in (".", "?.") and j >= 2:
        j -= 2
        if s.at(j) in (")", "]") and j in s.pair:
            j = s.pair[j]
            j = j - 1 if s.is_word(j - 1) else j
    return "".join(s.text[j : i - 1]), j


def _calls(s: Source, found: Found, caller_of, type_of, inferred_new=True):
    """Calls and constructions everywhere. caller_of(i): symbol of a token; type_of(i, name): declared type of a variable."""
    for i in range(s.n):
        if not s.is_word(i):
            continue
        after = s.skip_types(i + 1)
        if s.at(after) != "(" or s.text[i] in NOT_CALLS:
            continue
        if s.at(i - 1) in ("function", "func", "class", "interface", "enum", "record", "@") or i in found.declared:
            continue
        owner, j = _receiver(s, i)
        if s.at(j - 1) == "new":
            name = s.text[i]
            found.call(caller_of(i), name, None, None, s.argc(after), "new", s.line[j - 1], s.col[j - 1])
            continue
        kind_of = type_of(i, owner) if owner and owner not in ("this", "super") else None
        found.call(caller_of(i), s.text[i], owner, kind_of, s.argc(after), "super" if owner == "super" else "call", s.line[j], s.col[j])


class Cover:
    """What covers a token: of ranges (first, last, value) the shortest, of equal ones the least value. The answer between two
    bounds is found once, in one sweep, so that a lookup is a search and not a pass over all ranges of a file."""

    def __init__(self, ranges):
        ranges = sorted((a, b, v or "") for a, b, v in ranges if a <= b)
        self.at, self.value, open_, k = sorted({x for a, b, _ in ranges for x in (a, b + 1)}), [], [], 0
        for at in self.at:
            while k < len(ranges) and ranges[k][0] == at:
                a, b, v = ranges[k]
                heapq.heappush(open_, (b - a, v, b))
                k += 1
            while open_ and open_[0][2] < at:
                heapq.heappop(open_)
            self.value.append(open_[0][1] or None if open_ else None)

    def __call__(self, i: int):
        k = bisect.bisect_right(self.at, i) - 1
        return self.value[k] if k >= 0 else None


class Scopes:
    """Which symbol a token belongs to, and the types of variables: ranges of tokens, the innermost first. All ranges are there
    before the first lookup."""

    def __init__(self):
        self.owners, self.types, self.covers = [], [], None

    def _built(self):
        if self.covers is None:
            named = {}
            for a, b, n, t in self.types:
                named.setdefault(n, []).append((a, b, t))
            self.covers = Cover(self.owners), {n: Cover(ranges) for n, ranges in named.items()}
        return self.covers

    def owner(self, i: int):
        return self._built()[0](i)

    def type(self, i: int, name: str):
        found = self._built()[1].get(name)
        return found and found(i)


def java(rel: str, text: str) -> dict:
    s = Source(text)
    found, scopes = Found(rel, "java", s.lines), Scopes()
    found.declared = set()
    i = body = 0
    while i < s.n and s.at(i) not in ("class", "interface", "enum", "record", "@"):
        if s.at(i) in ("package", "import"):
            end = next((k for k in range(i, s.n) if s.at(k) == ";"), s.n)
            name = "".join(x for x in s.text[i + 1 : end] if x != "static")
            parts = name.split(".")
            if s.at(i) == "package":
                found.package = found.package or name
            elif parts[-1] != "*":
                found.imports.append(name)
                if s.at(i + 1) == "static" and len(parts) > 1:
                    found.bind(parts[-1], ".".join(parts[:-1]), "named")
                else:
                    found.bind(parts[-1], name, "class")
            i = body = end
        i += 1

    def types(a: int, b: int, prefix: str, parent):
        """Declarations between tokens a and b, a class body or the file."""
        i = first = a
        while i < b:
            t = s.at(i)
            if t in ("class", "interface", "enum", "record") and s.is_word(i + 1) and s.at(i - 1) not in (".", "@"):
                body = next((k for k in range(i, b) if s.at(k) == "{"), None)
                if body is None or body not in s.pair:
                    return
                name, end = s.text[i + 1], s.pair[body]
                doc = next((s.docs[k] for k in range(first, i + 1) if k in s.docs), None)
                near = doc and doc[1] + 1 >= s.line[first] and doc[2].startswith("/*")
                k = found.add("interface" if t == "interface" else "class", name, prefix + name, s.line[i + 1], s.line[end], parent, doc[0] if near else None)
                if t == "record" and s.at(i + 2) == "(":
                    params(i + 2, body, end)
                types(body + 1, end, f"{prefix}{name}.", k)
                i = first = end + 1
            elif s.kind[i] == "mark" and t == "(" and s.is_word(i - 1) and i in s.pair and parent and s.at(i - 2) not in (".", "new", "@", "="):
                name, close = s.text[i - 1], s.pair[i]
                j = close + 1
                while j < b and (s.is_word(j) or s.at(j) in (",", ".", "<", ">", "[", "]")):
                    j += 1
                typed = s.is_word(i - 2) or s.at(i - 2) in (">", "]")
                if s.at(j) in ("{", ";") and (typed or name == prefix.rstrip(".").rsplit(".", 1)[-1]):
                    end = s.pair.get(j, j)
                    found.declared.add(i - 1)
                    k = found.add("method", name, f"{prefix.rstrip('.')}#{name}", s.line[i - 1], s.line[end], parent)
                    scopes.owners.append((i, end, k))
                    params(i, i, end)
                    local(j, end)
                    i = first = end + 1
                else:
                    i = close + 1
            elif t == "@" and s.is_word(i + 1):
                i += 2
                while s.at(i) == "." and s.is_word(i + 1):
                    i += 2
                i = s.pair.get(i, i) + 1 if s.at(i) == "(" else i
            elif t == ";":
                fields(first, i, a, b)
                i += 1
                first = i
            elif t == "=":
                fields(first, i, a, b)
                i += 1
            elif s.kind[i] == "mark" and t in OPEN and i in s.pair:
                i = s.pair[i] + 1
                first = i if t == "{" else first
            else:
                i += 1

    def fields(first, i, a, b):
        if s.is_word(i - 1) and i - 2 >= first and (s.is_word(i - 2) or s.at(i - 2) in (">", "]")):
            scopes.types.append((a, b, s.text[i - 1], type_before(i - 1, first)))

    def type_before(i, first):
        """The type that ends before the name at i."""
        j = i - 1
        while j > first and s.at(j) in ("]", "["):
            j -= 1
        if s.at(j) == ">":
            depth = 0
            while j >= first:
                depth += (s.at(j) == ">") - (s.at(j) == "<")
                j -= 1
                if depth == 0:
                    break
        return s.text[j] if s.is_word(j) else None

    def params(i, a, b):
        for k in range(i + 1, s.pair[i]):
            if s.is_word(k) and s.at(k + 1) in (",", ")") and (s.is_word(k - 1) or s.at(k - 1) in (">", "]", "...")):
                scopes.types.append((a, b, s.text[k], type_before(k, i)))

    def local(a, b):
        for k in range(a, b):
            if s.is_word(k) and s.at(k + 1) in ("=", ";", ":") and (s.is_word(k - 1) or s.at(k - 1) in (">", "]")) and s.at(k - 1) not in NOT_CALLS:
                scopes.types.append((k, b, s.text[k], type_before(k, a)))

    types(body, s.n, "", 0)
    top = f"{found.package}." if found.package else ""
    for x in found.symbols[1:]:
        x["qname"] = top + x["qname"]
        x["parent"] = x["parent"] or None
    _calls(s, found, scopes.owner, lambda i, n: plain(t) if (t := scopes.type(i, n)) else None)
    return found.result()


def typescript(rel: str, text: str) -> dict:
    s = Source(text)
    found, scopes = Found(rel, "typescript", s.lines), Scopes()
    found.declared = set()
    prefix = re.sub(r"\.[A-Za-z]+$", "", rel)
    i = 0
    while i < s.n:
        if s.at(i) in ("import", "export") and s.at(i + 1) != "(":
            j = i + 1
            while j < s.n and s.at(j) not in (";", "class", "function", "const", "interface", "enum", "import", "=") and s.kind[j] != "text":
                j += 1
            if j < s.n and s.kind[j] == "text" and (s.at(j - 1) in ("from", "import")):
                source = s.text[j][1:-1]
                found.imports.append(source)
                k = i + 1
                while s.at(i) == "import" and k < j:
                    if s.at(k) == "{":
                        for m in range(k + 1, s.pair.get(k, k)):
                            if s.is_word(m) and s.text[m] not in ("as", "type") and s.at(m + 1) in (",", "}"):
                                renamed = s.at(m - 1) == "as"
                                found.bind(s.text[m], source, "named", s.text[m - 2] if renamed else None)
                        k = s.pair.get(k, k)
                    elif s.at(k) == "*" and s.at(k + 1) == "as":
                        found.bind(s.text[k + 2], source, "module")
                        k += 2
                    elif s.is_word(k) and s.text[k] not in ("from", "type", "as"):
                        found.bind(s.text[k], source, "default")
                    k += 1
                i = j
        i += 1

    def body_end(j):
        return s.pair.get(j, j)

    def walk(a, b, own, parent, top):
        i = a
        while i < b:
            t = s.at(i)
            if t in ("class", "enum", "interface") and s.is_word(i + 1) and s.at(i - 1) != ".":
                body = next((k for k in range(i, b) if s.at(k) == "{"), None)
                if body is None or body not in s.pair:
                    return
                name, end = s.text[i + 1], s.pair[body]
                k = found.add("interface" if t == "interface" else "class", name, f"{own}.{name}", s.line[i], s.line[end], parent)
                if t == "class":
                    members(body + 1, end, f"{own}.{name}", k)
                i = end + 1
            elif t == "function" and s.is_word(i + 1 + (s.at(i + 1) == "*")):
                at = i + 1 + (s.at(i + 1) == "*")
                i = function(at, s.skip_types(at + 1), b, s.line[i], f"{own}.{s.text[at]}", "function", parent, top)
            elif t in ("const", "let", "var") and s.is_word(i + 1) and s.at(i + 2) in ("=", ":"):
                j = next((k for k in range(i + 2, min(b, i + 60)) if s.at(k) == "="), None)
                j = j + 1 if j else i + 2
                j = j + 1 if s.at(j) == "async" else j
                close = s.pair.get(j) if s.at(j) == "(" else j if s.is_word(j) else None
                arrow = close is not None and next((k for k in range(close + 1, min(b, close + 20)) if s.at(k) in ("=>", ";", "{")), None)
                if arrow and s.at(arrow) == "=>" and top:
                    end = body_end(arrow + 1) if s.at(arrow + 1) == "{" else next((k for k in range(arrow, b) if s.at(k) == ";" or (s.at(k) in OPEN and False)), b - 1)
                    k = found.add("function", s.text[i + 1], f"{own}.{s.text[i + 1]}", s.line[i], s.line[end], parent)
                    scopes.owners.append((i, end, k))
                    if s.at(j) == "(":
                        params(j, end)
                    inferred(arrow, end)
                    i = arrow + 1
                else:
                    i += 2
            elif t == "{" and i in s.pair:
                i += 1
            else:
                i += 1

    def function(at, paren, b, line, qname, kind, parent, top):
        if s.at(paren) != "(" or paren not in s.pair:
            return at + 1
        j = s.pair[paren] + 1
        while j < b and s.at(j) not in ("{", ";", "}"):
            j = s.pair[j] + 1 if s.at(j) in ("(", "[") and j in s.pair else j + 1
        end = body_end(j) if s.at(j) == "{" else j
        found.declared.add(at)
        if top or kind == "method":
            k = found.add(kind, s.text[at], qname, line, s.line[min(end, s.n - 1)], parent)
            scopes.owners.append((paren, end, k))
        params(paren, end)
        inferred(j, end)
        return end + 1

    def members(a, b, qname, parent):
        i = a
        while i < b:
            paren = s.skip_types(i + 1)
            if s.is_word(i) and s.at(paren) == "(" and s.text[i] not in NOT_CALLS and s.at(i - 1) not in (".", "@", "=", "new"):
                i = function(i, paren, b, s.line[i], f"{qname}#{s.text[i]}", "method", parent, False)
            elif s.is_word(i) and s.at(i + 1) == ":" and s.is_word(i + 2):
                scopes.types.append((a, b, f"this.{s.text[i]}", s.text[i + 2]))
                i += 3
            elif s.kind[i] == "mark" and s.at(i) in OPEN and i in s.pair:
                i = s.pair[i] + 1
            else:
                i += 1

    def params(paren, end):
        for k in range(paren + 1, s.pair.get(paren, paren)):
            if s.is_word(k) and s.at(k + 1) == ":" and s.is_word(k + 2):
                scopes.types.append((paren, end, s.text[k], s.text[k + 2]))

    def inferred(a, b):
        for k in range(a, min(b, s.n)):
            if s.at(k) in ("const", "let", "var") and s.is_word(k + 1):
                if s.at(k + 2) == ":" and s.is_word(k + 3):
                    scopes.types.append((k, b, s.text[k + 1], s.text[k + 3]))
                elif s.at(k + 2) == "=" and s.at(k + 3) == "new":
                    scopes.types.append((k, b, s.text[k + 1], s.text[k + 4]))

    walk(0, s.n, prefix, None, True)
    _calls(s, found, scopes.owner, lambda i, n: plain(t) if (t := scopes.type(i, n)) else None)
    return found.result()


def go(rel: str, text: str) -> dict:
    s = Source(text)
    found, scopes = Found(rel, "go", s.lines), Scopes()
    found.declared = set()
    prefix = re.sub(r"\.go$", "", rel)
    owners: dict[str, int] = {}
    i = 0
    while i < s.n:
        t = s.at(i)
        if t == "package" and s.is_word(i + 1) and found.package is None:
            found.package = s.text[i + 1]
        elif t == "import":
            end = s.pair.get(i + 1, i + 3) if s.at(i + 1) == "(" else i + 3
            for k in range(i + 1, min(end, s.n)):
                if s.kind[k] == "text":
                    source = s.text[k][1:-1]
                    found.imports.append(source)
                    alias = s.text[k - 1] if s.is_word(k - 1) and s.text[k - 1] != "import" else source.rsplit("/", 1)[-1]
                    found.bind(alias, source, "module")
            i = end
        elif t == "type" and s.is_word(i + 1) and s.at(i + 2) in ("struct", "interface"):
            end = s.pair.get(i + 3, i + 3)
            kind = "class" if s.at(i + 2) == "struct" else "interface"
            owners[s.text[i + 1]] = found.add(kind, s.text[i + 1], f"{prefix}.{s.text[i + 1]}", s.line[i], s.line[min(end, s.n - 1)], None)
            i = end
        elif t == "func":
            j, owner, self_name = i + 1, None, None
            if s.at(j) == "(" and j in s.pair:
                words = [x for x in range(j + 1, s.pair[j]) if s.is_word(x)]
                owner = s.text[words[1] if len(words) > 1 else words[0]] if words else None
                self_name = s.text[words[0]] if len(words) > 1 else None
                j = s.pair[j] + 1
            if s.is_word(j) and s.at(j + 1) == "(" and j + 1 in s.pair:
                close = s.pair[j + 1]
                k = close + 1
                while k < s.n and s.at(k) != "{":
                    if s.line[k] > s.line[close] + 1:
                        break
                    k = s.pair[k] + 1 if s.at(k) in ("(", "[") and k in s.pair else k + 1
                end = s.pair.get(k, close)
                found.declared.add(j)
                name = s.text[j]
                qname = f"{prefix}.{owner}#{name}" if owner else f"{prefix}.{name}"
                me = found.add("method" if owner else "function", name, qname, s.line[i], s.line[end], owners.get(owner))
                scopes.owners.append((j, end, me))
                if self_name:
                    scopes.types.append((j, end, self_name, owner))
                i = k
        i += 1
    _calls(s, found, scopes.owner, lambda i, n: scopes.type(i, n))
    for c in found.calls:
        c["argc"] = None
    return found.result()


def python(rel: str, text: str) -> dict:
    lines = text.split("\n")
    found = Found(rel, "python", lines)
    tree = ast.parse(text)
    prefix = re.sub(r"\.py$", "", rel).replace("/", ".")
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                found.imports.append(a.name)
                found.bind(a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0], "module")
        elif isinstance(node, ast.ImportFrom):
            source = "." * node.level + (node.module or "")
            found.imports.append(source)
            for a in node.names:
                found.bind(a.asname or a.name, source, "named", a.name if a.asname else None)
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)

    def walk(body, own, parent, inside):
        for node in body:
            if isinstance(node, ast.ClassDef):
                k = found.add("class", node.name, f"{own}.{node.name}", node.lineno, node.end_lineno, parent)
                walk(node.body, f"{own}.{node.name}", k, True)
            elif isinstance(node, functions):
                k = found.add("method" if inside else "function", node.name, f"{own}{'#' if inside else '.'}{node.name}", node.lineno, node.end_lineno, parent)
                args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
                calls(node, k, {a.arg: plain(ast.unparse(a.annotation).strip("'\"")) for a in args if a.annotation})
            elif isinstance(node, (ast.If, ast.Try)):
                walk([*node.body, *node.orelse, *getattr(node, "finalbody", [])], own, parent, inside)

    def calls(node, caller, types):
        for x in ast.walk(node):
            if isinstance(x, ast.Call):
                argc = None if any(isinstance(a, ast.Starred) for a in x.args) or any(k.arg is None for k in x.keywords) else len(x.args) + len(x.keywords)
                if isinstance(x.func, ast.Name):
                    found.call(caller, x.func.id, None, None, argc, "call", x.lineno, x.col_offset + 1)
                elif isinstance(x.func, ast.Attribute):
                    owner = ast.unparse(x.func.value)
                    found.call(caller, x.func.attr, owner, types.get(owner), argc, "call", x.lineno, x.col_offset + 1)

    walk(tree.body, prefix, None, False)
    for node in tree.body:
        if not isinstance(node, (*functions, ast.ClassDef)):
            calls(node, None, {})
    return found.result()


PARSERS = {"java": java, "python": python, "typescript": typescript, "tsx": typescript, "javascript": typescript, "go": go}


def parse(rel: str, language: str | None, content: bytes) -> dict:
    """The parse of a file; its module symbol alone for other languages and unreadable files. ``status`` is ok, failed or
    skipped."""
    text = content.decode("utf-8", "replace")
    if language in PARSERS:
        try:
            return PARSERS[language](rel, text) | {"status": "ok"}
        except (SyntaxError, ValueError, RecursionError, IndexError):
            return Found(rel, language, text.split("\n")).result() | {"status": "failed"}
    return Found(rel, language or "", text.split("\n")).result() | {"status": "ok" if language else "skipped"}
