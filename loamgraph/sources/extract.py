"""Source texts to graph rows: declarations, containment, calls, imports, dependencies.

A text is lexed and bracketed once; the outermost level and class bodies are read for declarations, bodies for calls. Python texts go through the
language's own parser. A text that does not lex or parse gives its File and nothing else. Names are resolved afterwards, by joins.
"""

import ast
import bisect
import json
import posixpath
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.routes import api_call_name
from loamgraph.operators.traverse import reach
from loamgraph.sources.lexers import CLOSES, EXTENSIONS, Bad, lex
from loamgraph.sources.tables import Scratch

#: Languages whose names may call one another.
FAMILY = {"typescript": "ecma", "javascript": "ecma"}
_TYPES = {"java": ("class", "interface", "enum", "record"), "kotlin": ("class", "interface", "object"), "rust": ("struct", "enum", "trait"), "typescript": ("class", "interface", "enum"), "javascript": ("class",)}
_NO_CALL = frozenset("if for while switch catch return when match fn func fun function synchronized super this new throw sizeof typeof await yield assert try do else case in of is as not and or elif print".split())
_NO_TYPE = frozenset("let const var val mut return final static new throw else case in of package import".split())
#: Languages of extracted files: those of the lexers, and forms of the last two; a Svelte file is read through its inline scripts.
READ = {**EXTENSIONS, "tsx": "typescript", "mts": "typescript", "cts": "typescript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "svelte": "typescript"}
#: Packages whose functions send requests, verbs, and the verbs of one client's methods (`*` for any).
JS_CLIENTS = ("axios", "node-fetch")
VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
REST_TEMPLATE = {"getForObject": "GET", "getForEntity": "GET", "postForObject": "POST", "postForEntity": "POST", "postForLocation": "POST", "put": "PUT", "delete": "DELETE", "patchForObject": "PATCH", "headForHeaders": "HEAD", "optionsForAllow": "OPTIONS", "exchange": "*", "execute": "*"}
_SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script\s*>", re.S | re.I)
FACTS = "fact string, a string, b string, c string, kind string, name string, start_line int, end_line int, is_test boolean"


class _Item:
    __slots__ = ("kind", "text", "inner", "line", "end")

    def __init__(self, kind, text, line):
        self.kind, self.text, self.inner, self.line, self.end = kind, text, [], line, line

    def word(self, *of):
        return self.kind == "w" and (not of or self.text in of)


def _tree(text: str, language: str) -> list[_Item]:
    at: list[int] = []
    tokens = lex(text, language, at)
    starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
    levels, opened = [[]], []
    for (k, t, _), pos in zip(tokens, at):
        line = bisect.bisect_right(starts, pos)
        if k == "o" and t in "([{":
            x = _Item(t, t, line)
            levels[-1].append(x)
            opened.append(x)
            levels.append(x.inner)
        elif k == "o" and t in CLOSES:
            levels.pop()
            opened.pop().end = line
        else:
            levels[-1].append(_Item(k, t, line))
    return levels[0]


def _text(items: list[_Item]) -> str:
    shut = {"(": ")", "[": "]", "{": "}"}
    return "".join(x.text + _text(x.inner) + shut[x.kind] if x.kind in shut else x.text for x in items)


def _parts(items: list[_Item]) -> list[list[_Item]]:
    """Split at commas outside type arguments."""
    out, depth = [[]], 0
    for x in items:
        if x.kind == "o":
            depth += x.text.count("<") - (x.text.count(">") if x.text not in ("->", "=>") else 0)
        if x.kind == "o" and x.text == "," and depth <= 0:
            out.append([])
        else:
            out[-1].append(x)
    return [p for p in out if p]


def _parameters(items: list[_Item], language: str) -> list[tuple[str, str]]:
    """(name, type) of each parameter; type is empty where none is written."""
    out = []
    for p in _parts(items):
        cut = next((i for i, x in enumerate(p) if x.kind == "o" and x.text == "="), len(p))
        p = p[:cut]
        colon = next((i for i, x in enumerate(p) if x.kind == "o" and x.text == ":"), None)
        if language == "java":
            q, i = [], 0
            while i < len(p):
                if p[i].kind == "o" and p[i].text == "@":
                    i += 3 if i + 2 < len(p) and p[i + 2].kind == "(" else 2
                    continue
                if not p[i].word("final"):
                    q.append(p[i])
                i += 1
            if len(q) > 1 and q[-1].kind == "w":
                out.append((q[-1].text, _text(q[:-1])))
        elif language == "go":
            ws = [x for x in p if x.kind == "w"]
            out.append((p[0].text, _text(p[1:])) if len(p) > 1 and p[0].kind == "w" and ws else ("", _text(p)))
        elif colon is not None:
            names = [x.text for x in p[:colon] if x.kind == "w"]
            out.append((names[-1] if names else "", _text(p[colon + 1 :])))
        elif p and p[-1].kind == "w":
            out.append((p[-1].text, "self" if language == "rust" else ""))
    return [(n, t) for n, t in out if not (language == "rust" and n == "self")]


class _Reader:
    def __init__(self, path: str, text: str, language: str):
        self.path, self.language, self.rows = path, language, []
        name = posixpath.basename(path)
        low = path.lower()
        self.test = {"java": "src/test" in low or "org.junit" in text, "kotlin": "src/test" in low, "go": name.endswith("_test.go"), "rust": name.endswith("_test.rs") or "/tests/" in low, "python": name.startswith("test_") or name.endswith("_test.py") or "/tests/" in low}.get(
            language, ".test." in name or ".spec." in name or "__tests__" in low or name.split(".")[0].endswith("Test")
        ) or None
        self.node("File", path, name, 1, text.count("\n") + 1)
        try:
            if language == "python":
                self.python(text)
            else:
                items = _tree(text, language)
                self.prefix = {"java": self.package(items), "kotlin": self.package(items), "go": posixpath.dirname(path)}.get(language)
                if self.prefix is None:
                    self.prefix = path if language in FAMILY else path.rsplit(".", 1)[0].replace("/src/", "/").replace("/", "::")
                elif self.prefix:
                    self.node("Package", self.prefix, self.prefix.split(".")[-1], None, None)
                    self.link("contains", self.prefix, path)
                self.level(items, None)
        except (Bad, SyntaxError, ValueError, RecursionError, IndexError):
            self.rows = self.rows[:1]

    def node(self, kind, qn, name, start, end, test=None):
        self.rows.append(("node", qn, self.path, None, kind, name, start, end, (test if test is not None else self.test) if kind in ("Class", "Method", "Function", "File") else None))

    def link(self, fact, a, b, c=None):
        self.rows.append((fact, a, b, c, None, None, None, None, None))

    def package(self, items):
        for i, x in enumerate(items):
            if x.word("package"):
                j = i + 1
                while j < len(items) and (items[j].kind == "w" and (j == i + 1 or items[j - 1].text == ".") or items[j].text == "."):
                    j += 1
                return _text(items[i + 1 : j])
        return ""

    def inside(self, owner, name):
        sep = "::" if self.language == "rust" else "."
        base = owner or self.prefix
        return f"{base}{sep}{name}" if base else name

    def marks(self, items, i, qn):
        """Annotations between the end of what stands before and the declaration at i."""
        j = i - 1
        while j >= 0 and items[j].kind != "{" and items[j].text != ";":
            j -= 1
        for k in range(j + 1, i):
            if items[k].text == "@" and k + 1 < i and items[k + 1].kind == "w":
                args = next((x.inner for x in items[k + 2 : k + 3] if x.kind == "("), [])
                paths, method = [], None
                for part in _parts(args):
                    named = part[0].text if len(part) > 2 and part[1].text == "=" else None
                    texts = [y.text[1:-1] for x in part for y in (x.inner or [x]) if y.kind == "s"]
                    if named in (None, "value", "path"):
                        paths += texts
                    elif named == "method":
                        method = _text(part[2:])
                self.link("mark", qn, items[k + 1].text, json.dumps({"paths": paths, "method": method}))

    def callable(self, owner, name, params, body, line, before=None):
        types = ",".join(t or n for n, t in params)
        qn = f"{owner}#{name}({types})" if owner else f"{self.inside(None, name)}({types})"
        self.node("Method" if owner else "Function", qn, name, line, body.end if body else line)
        self.link("contains", owner or self.path, qn)
        if before is not None:
            self.marks(*before, qn)
        for _, t in params:
            if t and t != "self":
                self.link("uses", owner or self.path, t.split("<")[0].strip("&*[]?."))
        if body:
            self.calls(body.inner, qn, owner, dict((n, t) for n, t in params if n), [n for n, _ in params])

    def http(self, items, i, caller, known, receiver, params):
        """A call that sends a request: its verb and address, or the parameter that the address comes from, or the field that it is appended to.

        Recognised by where the callee comes from, never by syntax: an ambient or imported function of a known package, or a receiver of a known type.
        """
        name, args = items[i].text, _parts(items[i + 1].inner)
        first = args[0] if args else []
        verb = None
        if self.language in FAMILY:
            base = receiver.text if receiver is not None and receiver.kind == "w" else name if receiver is None and not (i and items[i - 1].text == ".") else None
            origin = self.bound_imports.get(base)
            if base and (origin in JS_CLIENTS if base in self.bound_imports else base == "fetch"):
                option = next((p[2].text.strip("'\"`").upper() for a in args[1:] for o in a if o.kind == "{" for p in _parts(o.inner) if len(p) == 3 and p[0].text == "method" and p[2].kind == "s"), "GET")
                verb = name.upper() if receiver is not None and name.upper() in VERBS else option if receiver is None else None
        elif self.language in ("java", "kotlin"):
            if known == "RestTemplate" and name in REST_TEMPLATE:
                named = next((a[2].text for a in args[1:] if len(a) == 3 and a[0].text == "HttpMethod"), None)
                verb = REST_TEMPLATE[name] if REST_TEMPLATE[name] != "*" else named or "*"
            elif name == "uri" and i >= 2:
                chain, j = [], i - 1
                while j > 0 and items[j].text == ".":
                    j -= 1
                    if items[j].kind == "(":
                        j -= 1
                    chain.append(items[j])
                    j -= 1
                root = self.types_here.get(chain[-1].text) if chain else None
                if root == "WebClient":
                    verb = next((w.text.upper() for w in chain if w.text.upper() in VERBS), "*")
        texts = [k for k, a in enumerate(args) if len(a) == 1 and a[0].kind == "s"]
        for k in texts:
            self.link("text_arg", caller, name, json.dumps({"at": k, "text": args[k][0].text}))
        if verb is None:
            return
        if len(first) == 1 and first[0].kind == "s":
            self.link("sends", caller, verb, json.dumps({"url": first[0].text if first[0].text != "``" else None}))
        elif len(first) == 3 and first[0].kind == "w" and first[1].text == "+" and first[2].kind == "s":
            self.link("sends", caller, verb, json.dumps({"url": first[2].text, "field": first[0].text}))
        elif len(first) == 1 and first[0].text in params:
            self.link("sends_param", caller, verb, str(params.index(first[0].text)))

    bound_imports: dict = {}
    types_here: dict = {}

    def calls(self, items, caller, owner, bound, params=()):
        self.types_here = {**{n: t for (o, n), t in self.fields.items() if o == owner}, **bound}
        for i, x in enumerate(items):
            nxt = items[i + 1] if i + 1 < len(items) else None
            if x.kind == "w" and x.text not in _NO_TYPE and nxt is not None and nxt.kind == "w" and i + 2 < len(items) and items[i + 2].kind == "o" and items[i + 2].text in ("=", ";", ":"):
                bound.setdefault(nxt.text, x.text)
            if x.kind == "w" and nxt is not None and nxt.kind == "(" and x.text not in _NO_CALL and not (i and items[i - 1].word("new", "fn", "func", "fun", "function")):
                receiver = items[i - 2] if i >= 2 and items[i - 1].kind == "o" and items[i - 1].text in (".", "?.", "::") else None
                if receiver is None and not (i and items[i - 1].kind == "o" and items[i - 1].text in (".", "?.", "::")):
                    known = owner.split(".")[-1].split("::")[-1] if owner else None
                elif receiver is not None and receiver.kind == "w":
                    known = owner.split(".")[-1].split("::")[-1] if receiver.text in ("this", "self", "Self") and owner else bound.get(receiver.text) or self.fields.get((owner, receiver.text)) or ("?" + receiver.text if receiver.text[:1].isupper() else None)
                else:
                    known = None
                self.link("call", caller, x.text, (known or "").split("<")[0] or None)
                self.http(items, i, caller, known, receiver, params)
            if x.inner:
                self.calls(x.inner, caller, owner, bound, params)

    fields: dict = {}

    def level(self, items, owner):
        """Declarations of one level: the file's, or a class body's."""
        g, n, i = self.language, len(items), 0
        if owner is not None or g != "java":
            self.fields = dict(self.fields)
        for k in range(1, n - 1):
            if g == "java" and items[k].kind == "w" and items[k - 1].kind in ("w", "o") and items[k + 1].kind == "o" and items[k + 1].text in (";", "="):
                t = items[k - 1].text if items[k - 1].kind == "w" else None
                if t:
                    self.fields[owner, items[k].text] = t
                    self.link("uses", owner or self.path, t)
                    at = next((q for q in range(k - 1, max(-1, k - 8), -1) if items[q].word("Value") and q and items[q - 1].text == "@" and items[q + 1].kind == "("), None)
                    if at is not None and items[at + 1].inner and items[at + 1].inner[0].kind == "s":
                        self.link("config", owner, items[k].text, items[at + 1].inner[0].text[1:-1])
        while i < n:
            x = items[i]
            nxt = items[i + 1] if i + 1 < n else None
            if x.word("import", "use", "from") and owner is None:
                j = i + 1
                if g == "go" and nxt is not None and nxt.kind == "(":
                    for y in nxt.inner:
                        if y.kind == "s":
                            self.link("import", self.path, y.text.strip('"`'))
                    i += 2
                    continue
                while j < n and items[j].text != ";" and not (g in ("kotlin", "go") and items[j].line > x.line) and not (items[j].kind == "s"):
                    j += 1
                raw = items[j].text.strip("'\"`") if j < n and items[j].kind == "s" else _text([y for y in items[i + 1 : j] if not y.word("static")])
                self.link("import", self.path, raw)
                if g in FAMILY and j < n and items[j].kind == "s":
                    flat = [y for x in items[i + 1 : j] for y in (x.inner if x.kind == "{" else [x])]
                    self.bound_imports = {**self.bound_imports, **{y.text: raw for y in flat if y.kind == "w" and y.text not in ("from", "as", "type", "default")}}
                i = j + 1 if j < n and (items[j].kind == "s" or items[j].text == ";") else j
                continue
            if g in _TYPES and x.word(*_TYPES[g]) and nxt is not None and nxt.kind == "w" and not (i and items[i - 1].text in (".", "::")):
                qn = self.inside(owner, nxt.text)
                j = i + 2
                while j < n and items[j].kind != "{" and items[j].text != ";" and not (g == "kotlin" and items[j].word("class", "fun", "val", "var", "interface", "object") and items[j].line > x.line):
                    if items[j].word("extends", "implements") or (g == "kotlin" and items[j].text == ":"):
                        for y in items[j + 1 : j + 12]:
                            if y.kind == "{":
                                break
                            if y.kind == "w" and y.text[:1].isupper():
                                self.link("extends", qn, y.text)
                    if g == "kotlin" and items[j].kind == "(" and items[j - 1].text == nxt.text:
                        for _, t in _parameters(items[j].inner, g):
                            self.link("uses", qn, t.split("<")[0].strip("?"))
                    j += 1
                body = items[j] if j < n and items[j].kind == "{" else None
                self.node("Class", qn, nxt.text, x.line, body.end if body else x.line)
                self.link("contains", owner or self.path, qn)
                if g in ("java", "kotlin"):
                    self.marks(items, i, qn)
                if body and g != "rust":
                    self.level(body.inner, qn)
                i = j + 1
                continue
            if g == "go" and x.word("type") and nxt is not None and nxt.kind == "w" and i + 2 < n and items[i + 2].kind == "w":
                qn = self.inside(None, nxt.text)
                body = next((y for y in items[i + 2 : i + 4] if y.kind == "{"), None)
                self.node("Class", qn, nxt.text, x.line, body.end if body else x.line)
                self.link("contains", self.path, qn)
                for y in body.inner if body else []:
                    if y.kind == "w" and y.text[:1].isupper():
                        self.link("uses", qn, y.text)
                i += 3
                continue
            if g == "rust" and x.word("impl"):
                j = i + 1
                while j < n and items[j].kind != "{":
                    j += 1
                head = items[i + 1 : j]
                after = next((k for k, y in enumerate(head) if y.word("for")), None)
                names = [y.text for y in (head[after + 1 :] if after is not None else head) if y.kind == "w" and y.text[:1].isupper()]
                if j < n and names:
                    self.level(items[j].inner, self.inside(None, names[0]))
                i = j + 1
                continue
            if g == "rust" and x.word("mod") and nxt is not None and i + 2 < n and items[i + 2].kind == "{":
                held, self.prefix = self.prefix, self.inside(None, nxt.text)
                self.level(items[i + 2].inner, None)
                self.prefix = held
                i += 3
                continue
            done = self.function(items, i, owner)
            i = done if done else i + 1

    def function(self, items, i, owner):
        """Reads a callable that begins at i; gives the place after it, or nothing."""
        g, n, x = self.language, len(items), items[i]
        if g == "go":
            if not x.word("func"):
                return None
            j, own = i + 1, None
            if j < n and items[j].kind == "(":
                names = [y.text for y in items[j].inner if y.kind == "w"]
                own, j = (self.inside(None, names[-1]) if names else None), j + 1
            if j + 1 >= n or items[j].kind != "w":
                return None
            k = j + 1
            while k < n and items[k].kind != "(":
                k += 1
            body = next((y for y in range(k + 1, n) if items[y].kind == "{" or items[y].word("func", "type", "var", "const")), n)
            self.callable(own, items[j].text, _parameters(items[k].inner, g), items[body] if body < n and items[body].kind == "{" else None, x.line)
            return body + 1
        if g in ("kotlin", "rust") or (g in FAMILY and owner is None and x.word("function")):
            if not x.word("fun", "fn", "function"):
                return None
            k = i + 1
            while k < n and items[k].kind != "(":
                k += 1
            if k >= n or items[k - 1].kind not in ("w", "o"):
                return None
            name = next((y.text for y in (reversed(items[i + 1 : k]) if g == "kotlin" else items[i + 1 : k]) if y.kind == "w"), None)
            stop = next((y for y in range(k + 1, n) if items[y].kind == "{" or items[y].text == ";" or items[y].word("fun", "fn", "val", "var", "class", "object", "function")), n)
            if name:
                self.callable(owner, name, _parameters(items[k].inner, g), items[stop] if stop < n and items[stop].kind == "{" else None, x.line, (items, i) if g == "kotlin" else None)
            return stop + 1 if stop < n and items[stop].kind == "{" else max(stop, k + 1)
        if g in FAMILY and owner is None:
            if x.word("const", "let", "var") and i + 3 < n and items[i + 1].kind == "w" and items[i + 2].text == "=":
                k = i + 3 + items[i + 3].word("async")
                arrow = next((y for y in range(k, min(k + 8, n)) if items[y].text == "=>"), None)
                if arrow and k < n and items[k].kind == "(":
                    body = items[arrow + 1] if arrow + 1 < n and items[arrow + 1].kind == "{" else None
                    self.callable(None, items[i + 1].text, _parameters(items[k].inner, g), body, x.line)
                    return arrow + 1
            return None
        # a member: a name, parameters, and a body or an end
        if x.kind == "w" and i + 1 < n and items[i + 1].kind == "(" and owner is not None and not (i and items[i - 1].text in (".", "=", "@", "->", "=>")) and not x.word("new"):
            k = i + 2
            while k < n and items[k].kind != "{" and items[k].text not in (";", "=", "(") and items[k].kind != "(":
                k += 1
            body = items[k] if k < n and items[k].kind == "{" else None
            if body or (k < n and items[k].text == ";"):
                self.callable(owner, x.text, _parameters(items[i + 1].inner, g), body, x.line, (items, i) if g == "java" else None)
                return k + 1
        return None

    def python(self, text):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            module = ast.parse(text)

        def calls(node, caller, owner):
            for sub in ast.walk(node):
                if isinstance(sub, ast.Call):
                    f = sub.func
                    if isinstance(f, ast.Name):
                        self.link("call", caller, f.id)
                    elif isinstance(f, ast.Attribute):
                        own = isinstance(f.value, ast.Name) and f.value.id in ("self", "cls")
                        self.link("call", caller, f.attr, owner if own else None)

        def define(node, owner):
            names = [a.arg for a in [*node.args.posonlyargs, *node.args.args]] + ([f"*{node.args.vararg.arg}"] if node.args.vararg else []) + [a.arg for a in node.args.kwonlyargs]
            qn = f"{owner}#{node.name}({','.join(names)})" if owner else f"{node.name}({','.join(names)})"
            test = True if self.test or node.name.startswith("test_") else None
            self.node("Method" if owner else "Function", qn, node.name, node.lineno, node.end_lineno, test)
            self.link("contains", owner or self.path, qn)
            for d in node.decorator_list:
                if isinstance(d, (ast.Name, ast.Attribute)):
                    self.link("call", qn, d.id if isinstance(d, ast.Name) else d.attr)
            calls(node, qn, owner)

        for node in module.body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                define(node, None)
            elif isinstance(node, ast.ClassDef):
                self.node("Class", node.name, node.name, node.lineno, node.end_lineno)
                self.link("contains", self.path, node.name)
                for b in node.bases:
                    if isinstance(b, ast.Name):
                        self.link("extends", node.name, b.id)
                for sub in node.body:
                    if isinstance(sub, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        define(sub, node.name)
            elif isinstance(node, (ast.Import, ast.ImportFrom)):
                for a in node.names:
                    self.link("import", self.path, a.name if isinstance(node, ast.Import) else f"{'.' * node.level}{node.module or ''}.{a.name}")
            elif isinstance(node, (ast.Assign, ast.AnnAssign)):
                for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(t, ast.Name):
                        self.node("Variable", t.id, t.id, node.lineno, node.end_lineno)
                        self.link("contains", self.path, t.id)


def scripts_only(text: str) -> str:
    """A Svelte text with all but its inline scripts blanked; lines keep their numbers. Scripts with a `src` hold no code."""
    out, at = [], 0
    blank = lambda t: re.sub(r"[^\r\n]", " ", t)
    for m in _SCRIPT.finditer(text):
        if not re.search(r"\bsrc\s*=", m[1]):
            out += [blank(text[at : m.start(2)]), m[2]]
            at = m.end(2)
    return "".join([*out, blank(text[at:])])


def _language(path: str | None) -> str | None:
    return READ.get((path or "").rsplit(".", 1)[-1].lower())


def read_source(path: str | None, text: str | None) -> list[tuple]:
    """All facts of one text; none for a null or one of no known extension."""
    language = _language(path)
    if not language or text is None:
        return []
    return _Reader(path, scripts_only(text) if path.lower().endswith(".svelte") else text, language).rows


def facts(files: DataFrame) -> DataFrame:
    """repo, source_commit, committed_at (if there), family and the facts of every file, one file at a time, without a shuffle."""
    keep = [c for c in ("repo", "source_commit", "committed_at") if c in files.columns]
    types = dict(files.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in FACTS.split(", ")]
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                g = _language(row.path)
                out += [(*[getattr(row, c) for c in keep], FAMILY.get(g, g), *f) for f in read_source(row.path, row.content)]
            df = pd.DataFrame(out, columns=[*keep, "family", *names])
            for c in ("start_line", "end_line"):
                df[c] = df[c].astype("Int32")
            df["is_test"] = df["is_test"].astype("boolean")
            yield df

    ddl = ", ".join([f"{c} {types[c]}" for c in keep] + ["family string", FACTS])
    return files.select(*keep, "path", "content").mapInPandas(run, ddl)


def extracted_nodes(f: DataFrame) -> DataFrame:
    """Nodes of each repository and commit, once each."""
    n = f.where(F.col("fact") == "node")
    return n.select("repo", "source_commit", "kind", F.col("a").alias("qualified_name"), "name", F.when(F.col("kind") != "Package", F.col("b")).alias("path"), "start_line", "end_line", "is_test").dropDuplicates(["repo", "source_commit", "kind", "qualified_name"])


def annotations(f: DataFrame, kind: str) -> DataFrame:
    """repo, source_commit, id, marks (name, paths, method) of annotated nodes of a kind."""
    ids = f.where((F.col("fact") == "node") & (F.col("kind") == kind)).select("repo", "source_commit", "a").distinct()
    m = f.where(F.col("fact") == "mark").withColumn("j", F.from_json("c", "paths array<string>, method string"))
    m = m.select("repo", "source_commit", "a", F.struct(F.col("b").alias("name"), F.col("j.paths").alias("paths"), F.col("j.method").alias("method")).alias("m"))
    return m.join(ids, ["repo", "source_commit", "a"], "left_semi").groupBy("repo", "source_commit", F.col("a").alias("id")).agg(F.collect_list("m").alias("marks"))


def call_edges(f: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """repo, source_commit, src, dst, resolution of calls.

    Java: a receiver's type names a class by its simple name; of several the one that the caller's file imports, else all of them as a guess. The call goes to the methods of that
    name of the class and of all classes above and below it, at any distance, but not of its siblings: `typed`, or `name` after a guess. If a receiver's type is known and
    none is found, there is no edge; calls in a class's own scope, of unknown type or on a name that is no class here, then go to every method of the name, as `name`. Typed beats name.
    Other languages: to every callable of the name in the same family, without a resolution. No callable calls itself here.
    """
    scratch = scratch or Scratch(f.sparkSession)
    key = ["repo", "source_commit"]
    nodes = f.where(F.col("fact") == "node")
    able = nodes.where(F.col("kind").isin("Method", "Function")).select(*key, "family", F.col("a").alias("dst"), "name").distinct()
    sites = f.where(F.col("fact") == "call").select(*key, "family", F.col("a").alias("src"), F.col("b").alias("name"), F.col("c").alias("type")).distinct()
    other = sites.where(F.col("family") != "java").select(*key, "family", "src", "name").distinct().join(able, [*key, "family", "name"]).select(*key, "src", "dst", F.lit(None).cast("int").alias("r"))
    java = scratch.keep(sites.where(F.col("family") == "java").drop("family"))
    able = able.where(F.col("family") == "java").drop("family")
    classes = scratch.keep(nodes.where((F.col("kind") == "Class") & (F.col("family") == "java")).select(*key, F.col("a").alias("cid"), F.col("name").alias("type")).distinct())
    mine = F.when(F.col("src").contains("#"), F.element_at(F.split("src", "#"), 1))
    java = java.withColumns({"static": F.coalesce(F.col("type").startswith("?"), F.lit(False)), "type": F.regexp_replace("type", r"^\?", ""), "mine": mine})
    own = java.where(~F.col("static") & (F.col("type") == F.element_at(F.split("mine", r"\."), -1)))
    inside = own.select(*key, "src", "name", "type", F.col("mine").alias("cid"), F.lit(1).alias("precise"), F.lit(False).alias("blocks"))
    foreign = java.where(F.col("type").isNotNull()).join(own.select(*key, "src", "name", "type").distinct(), [*key, "src", "name", "type"], "left_anti")
    path = nodes.select(*key, F.col("a").alias("src"), F.col("b").alias("path")).distinct()
    brought = f.where(F.col("fact") == "import").select(*key, F.col("a").alias("path"), F.col("b").alias("cid"), F.lit(1).alias("brought")).distinct()
    cands = foreign.join(classes, [*key, "type"]).join(path, [*key, "src"], "left").join(brought, [*key, "path", "cid"], "left")
    site = Window.partitionBy(*key, "src", "name", "type")
    cands = cands.withColumns({"n": F.count(F.lit(1)).over(site), "k": F.sum(F.coalesce("brought", F.lit(0))).over(site)})
    cands = cands.where((F.col("k") != 1) | (F.col("brought") == 1))
    seeds = inside.unionByName(cands.select(*key, "src", "name", "type", "cid", ((F.col("n") == 1) | (F.col("k") == 1)).cast("int").alias("precise"), F.lit(True).alias("blocks")))
    # a declared type that is no class here says that the callee is none of these methods either
    unknown = foreign.where(~F.col("static")).join(classes.select(*key, "type").distinct(), [*key, "type"], "left_anti").select(*key, "src", "name", "type")
    seeds = scratch.keep(seeds)
    full = lambda c: F.concat_ws("\x00", "repo", "source_commit", c)
    ext = f.where((F.col("fact") == "extends") & (F.col("family") == "java")).select(*key, F.col("a").alias("below"), F.col("b").alias("type")).distinct()
    steps = scratch.keep(ext.join(classes, [*key, "type"]).select(full("below").alias("a"), full("cid").alias("b")).distinct())
    ends = scratch.keep(seeds.select(full("cid").alias("seed")).distinct().withColumn("id", F.col("seed")))
    kin = reach(ends, steps, 64, fan_out=None, scratch=scratch).union(reach(ends, steps.select(F.col("b").alias("a"), F.col("a").alias("b")), 64, fan_out=None, scratch=scratch))
    kin = kin.select("seed", "id").union(ends.select("seed", "id")).distinct()
    methods = able.where(F.col("dst").contains("#")).select(full(F.element_at(F.split("dst", "#"), 1)).alias("id"), "name", "dst")
    hits = seeds.withColumn("seed", full("cid")).join(kin, "seed").join(methods, ["id", "name"]).select(*key, "src", "name", "type", "dst", F.col("precise").alias("r")).distinct()
    hits = scratch.keep(hits)
    settled = hits.select(*key, "src", "name", "type").union(seeds.where("blocks").select(*key, "src", "name", "type")).union(unknown).distinct()
    none = lambda df: df.withColumn("type", F.coalesce("type", F.lit("")))
    rest = none(java.select(*key, "src", "name", "type")).distinct().join(none(settled), [*key, "src", "name", "type"], "left_anti")
    named = rest.select(*key, "src", "name").distinct().join(able, [*key, "name"]).select(*key, "src", "dst", F.lit(0).alias("r"))
    both = hits.select(*key, "src", "dst", "r").union(named).union(other).where(F.col("src") != F.col("dst"))
    c = both.groupBy(*key, "src", "dst").agg(F.max("r").alias("r"))
    return c.select(*key, "src", "dst", F.when(F.col("r") == 1, "typed").when(F.col("r") == 0, "name").alias("resolution"))


def api_calls(f: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """repo, source_commit, caller, qualified_name, host, derived: requests that sources send, as `apicall:VERB /path`, once each.

    A literal address names its path. An address appended to a configured field counts if `hosts` (repo, field, host) grounds that field, and is derived. So is one that a helper takes as a
    parameter: every literal passed at that place to a callable of the helper's name in its repository is an address. Others give no row.
    """
    key = ["repo", "source_commit"]
    sent = f.where(F.col("fact") == "sends").select(*key, F.col("a").alias("caller"), F.col("b").alias("verb"), F.from_json("c", "url string, field string").alias("j"))
    literal = sent.where(F.col("j.field").isNull()).select(*key, "caller", "verb", F.col("j.url").alias("url"), F.lit(None).cast("string").alias("host"), F.lit(False).alias("derived"))
    parts = [literal]
    if hosts is not None:
        grounded = sent.where(F.col("j.field").isNotNull()).withColumn("field", F.col("j.field")).join(hosts.select("repo", "field", F.col("host").alias("h")).where(F.col("h").isNotNull()), ["repo", "field"])
        parts.append(grounded.select(*key, "caller", "verb", F.col("j.url").alias("url"), F.col("h").alias("host"), F.lit(True).alias("derived")))
    helper = f.where(F.col("fact") == "sends_param").select(*key, F.col("a").alias("helper"), F.col("b").alias("verb"), F.col("c").cast("int").alias("at"))
    named = f.where((F.col("fact") == "node") & F.col("kind").isin("Method", "Function")).select(*key, F.col("a").alias("helper"), "name").distinct()
    given = f.where(F.col("fact") == "text_arg").select(*key, F.col("a").alias("caller"), F.col("b").alias("name"), F.from_json("c", "at int, text string").alias("j"))
    one = helper.join(named, [*key, "helper"]).join(given.select(*key, "caller", "name", F.col("j.at").alias("at"), F.col("j.text").alias("url")), [*key, "name", "at"])
    parts.append(one.select(*key, "caller", "verb", "url", F.lit(None).cast("string").alias("host"), F.lit(True).alias("derived")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("qualified_name", api_call_name(F.col("verb"), F.col("url"))).where(F.col("qualified_name").isNotNull())
    return rows.groupBy(*key, "caller", "qualified_name").agg(F.max("host").alias("host"), F.min("derived").alias("derived"))


def extracted_edges(f: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """CONTAINS, CALLS (`call_edges`), DEPENDS_ON and IMPORTS of each repository and commit: repo, source_commit, kind, src, dst, resolution.

    Dependencies rest on simple type names. Relative imports are looked for as written, with the extensions, and as index files, in that order.
    """
    key = ["repo", "source_commit"]
    nodes = f.where(F.col("fact") == "node")
    c = call_edges(f, scratch)
    out = [c.select(*key, F.lit("CALLS").alias("kind"), "src", "dst", "resolution")]
    none = F.lit(None).cast("string").alias("resolution")
    out.append(f.where(F.col("fact") == "contains").select(*key, F.lit("CONTAINS").alias("kind"), F.col("a").alias("src"), F.col("b").alias("dst"), none).distinct())
    classes = nodes.where(F.col("kind") == "Class").select(*key, "family", F.col("a").alias("dst"), F.col("name").alias("b")).distinct()
    uses = f.where(F.col("fact").isin("uses", "extends") & ~F.col("family").isin("rust", "python")).select(*key, "family", F.col("a").alias("src"), "b").distinct()
    out.append(uses.join(classes, [*key, "family", "b"]).where(F.col("src") != F.col("dst")).select(*key, F.lit("DEPENDS_ON").alias("kind"), "src", "dst", F.lit("name").alias("resolution")).distinct())
    imports = f.where((F.col("fact") == "import") & (F.col("family") != "kotlin")).select(*key, "family", F.col("a").alias("src"), F.col("b").alias("raw")).distinct()
    out.append(imports.where(F.col("family") != "ecma").join(nodes.where(F.col("kind").isin("Class", "Package")).select(*key, F.col("a").alias("raw")).distinct(), [*key, "raw"], "left_semi").select(*key, F.lit("IMPORTS").alias("kind"), "src", F.col("raw").alias("dst"), none))
    relative = imports.where((F.col("family") == "ecma") & F.col("raw").startswith("."))
    at = F.concat(F.regexp_replace("src", r"[^/]*$", ""), F.col("raw"))
    flat = F.aggregate(F.split(at, "/"), F.array().cast("array<string>"), lambda s, x: F.when((x == ".") | (x == ""), s).when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(x))))
    base = F.array_join(flat, "/")
    ways = ["", ".ts", ".tsx", ".js", ".jsx", ".svelte", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.svelte"]
    tried = relative.select(*key, "src", "raw", F.posexplode(F.array(*[F.concat(base, F.lit(w)) for w in ways])).alias("rank", "dst"))
    there = tried.join(nodes.where(F.col("kind") == "File").select(*key, F.col("a").alias("dst")).distinct(), [*key, "dst"], "left_semi")
    first = there.withColumn("rn", F.row_number().over(Window.partitionBy(*key, "src", "raw").orderBy("rank"))).where(F.col("rn") == 1)
    out.append(first.select(*key, F.lit("IMPORTS").alias("kind"), "src", "dst", none))
    edges = out[0]
    for e in out[1:]:
        edges = edges.unionByName(e)
    return edges.distinct()
