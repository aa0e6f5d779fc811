"""Facts from source files: definitions, containment, imports, inheritance, calls, tests.

Python is parsed with the standard library; other languages are read by a scanner that masks
comments and strings, finds definitions by patterns and their bodies by brackets (or by
``end``). Without a grammar the scanner is an approximation; both are plain functions from a path
and bytes to facts and can be replaced. Any bytes give facts or none, never an error.
"""

from __future__ import annotations

import ast
import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grapheion.operators.graph import EDGE_SCHEMA, NODE_SCHEMA
from grapheion.operators.resolution import FileFacts, graph_of
from grapheion.shipping import ship
from grapheion.sources.files import EXTENSIONS

MAX_DEPTH = 180
TEST_RUNNERS = ["describe", "it", "test", "beforeEach", "afterEach", "beforeAll", "afterAll"]
ROUTE_METHODS = ["get", "post", "put", "patch", "delete", "use", "all", "route", "head", "options"]
LISTENERS = ["on", "once", "addEventListener", "addListener", "subscribe"]
HEAD_CHARS = 4000


def is_test_file(path: str) -> bool:
    p = path.replace("\\", "/")
    return any(x in p for x in ("test_", "_test.", ".test.", ".spec.", "_spec.", "/tests/", "/test/"))


def is_test_name(name: str, path: str) -> bool:
    return name.startswith(("test_", "Test")) or is_test_file(path) and name in TEST_RUNNERS


def language_of_path(path: str) -> str | None:
    base = path.replace("\\", "/").rsplit("/", 1)[-1]
    return EXTENSIONS.get(base.rsplit(".", 1)[-1].lower()) if "." in base else None


@dataclass
class Definition:
    kind: str
    name: str
    start: int
    end: int
    body: bytes
    signature: str = ""
    docstring: str = ""
    bases: list[str] = field(default_factory=list)
    owner: str = ""
    is_test: bool = False


@dataclass
class Facts:
    """What a file says, before names are resolved."""

    path: str
    language: str
    n_lines: int = 1
    definitions: list[Definition] = field(default_factory=list)
    imports: list[tuple[str, list[str], int]] = field(default_factory=list)  # module, names it brings, line
    calls: list[tuple[str, int]] = field(default_factory=list)


# Python ----------------------------------------------------------------------------
def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Attribute):
        left = _dotted(node.value)
        return f"{left}.{node.attr}" if left else node.attr
    return node.id if isinstance(node, ast.Name) else _dotted(node.func) if isinstance(node, ast.Call) else _dotted(node.value) if isinstance(node, ast.Subscript) else ""


def read_python(path: str, text: str) -> Facts:
    facts = Facts(path, "python", text.count("\n") + 1)
    lines = text.split("\n")
    tree = ast.parse(text)

    def body(n: ast.AST) -> bytes:
        return "\n".join(lines[n.lineno - 1 : n.end_lineno]).encode()

    def visit(node: ast.AST, owner: str, depth: int, in_function: bool) -> None:
        if depth > MAX_DEPTH:
            return
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.ClassDef):
                facts.definitions.append(Definition("Class", n.name, n.lineno, n.end_lineno, body(n), docstring=ast.get_docstring(n) or "", bases=[b for b in map(_dotted, n.bases) if b], owner="", is_test=is_test_name(n.name, path)))
                visit(n, n.name, depth + 1, False)
            elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                sig = f"({ast.unparse(n.args)})" + (f" -> {ast.unparse(n.returns)}" if n.returns else "")
                test = is_test_name(n.name, path)
                facts.definitions.append(Definition("Test" if test else "Function", n.name, n.lineno, n.end_lineno, body(n), sig, ast.get_docstring(n) or "", owner=owner, is_test=test))
                visit(n, owner, depth + 1, True)
            else:
                if isinstance(n, ast.Import):
                    facts.imports += [(a.name, [a.asname or a.name.split(".")[0]], n.lineno) for a in n.names]
                elif isinstance(n, ast.ImportFrom):
                    facts.imports.append(("." * n.level + (n.module or ""), [a.asname or a.name for a in n.names], n.lineno))
                elif isinstance(n, ast.Call) and in_function and (name := _dotted(n.func)):
                    facts.calls.append((name.rsplit(".", 1)[-1], n.lineno))
                visit(n, owner, depth + 1, in_function)

    visit(tree, "", 0, False)
    return facts


# other languages ------------------------------------------------------------------------
_NAME = r"[A-Za-z_$][\w$]*"
_PARAMS = r"\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)"
_C_STYLE = [("Function", rf"(?:^|(?<=[{{}};]))[ \t]*(?:[\w$<>\[\],.&*~?:]+[ \t]+)+[*&]*(?:{_NAME}(?:::|\.))*(?P<name>~?{_NAME})[ \t]*{_PARAMS}[^;{{}}=]*\{{")]
_CLASSES = [("Class", rf"\b(?:class|struct|enum|union|record|object)[ \t]+(?:class[ \t]+)?(?P<name>{_NAME})(?P<rest>[^{{;]*)\{{"), ("Type", rf"\b(?:interface|protocol|trait)[ \t]+(?P<name>{_NAME})(?P<rest>[^{{;]*)\{{")]
_JS = [
    ("Class", rf"\bclass[ \t]+(?P<name>{_NAME})(?P<rest>[^{{]*)\{{"),
    ("Type", rf"\binterface[ \t]+(?P<name>{_NAME})(?P<rest>[^{{]*)\{{"),
    ("Type", rf"\btype[ \t]+(?P<name>{_NAME})[^=;\n]*="),
    ("Class", rf"\benum[ \t]+(?P<name>{_NAME})[^{{]*\{{"),
    ("Function", rf"\bfunction\b[ \t]*\*?[ \t]*(?P<name>{_NAME})[^(]*{_PARAMS}[^{{;]*\{{"),
    ("Function", rf"\b(?:const|let|var)[ \t]+(?P<name>{_NAME})[^=;\n]*=[ \t]*(?:async[ \t]*)?(?:function\b[^(]*{_PARAMS}|{_PARAMS.replace('params', 'params2')}[^=;{{}}\n]*=>|{_NAME}[ \t]*=>)"),
    ("Function", rf"^[ \t]+(?:(?:public|private|protected|static|async|get|set|readonly|override)[ \t]+)*\*?(?P<name>{_NAME})[ \t]*(?:<[^>]*>)?{_PARAMS}[^;{{}}=]*\{{"),
]
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "javascript": _JS, "typescript": _JS, "tsx": _JS,
    "java": [*_CLASSES, *_C_STYLE], "csharp": [*_CLASSES, *_C_STYLE], "cpp": [*_CLASSES, *_C_STYLE],
    "c": [*_CLASSES, ("Class", rf"\btypedef\b[^;{{}}]*?\b(?P<name>{_NAME})[ \t]*;"), ("Class", rf"\}}[ \t]*(?P<name>{_NAME})[ \t]*;"), *_C_STYLE],
    "go": [("Type", rf"\btype[ \t]+(?P<name>{_NAME})[ \t]+interface\b"), ("Class", rf"\btype[ \t]+(?P<name>{_NAME})[ \t]+struct\b"), ("Function", rf"\bfunc[ \t]+(?:\([^)]*?(?P<recv>{_NAME})\)[ \t]*)?(?P<name>{_NAME})[ \t]*(?:\[[^\]]*\])?{_PARAMS}[^{{\n]*\{{")],
    "rust": [("Class", rf"\b(?:struct|enum|union)[ \t]+(?P<name>{_NAME})"), ("Type", rf"\btrait[ \t]+(?P<name>{_NAME})(?P<rest>[^{{;]*)\{{"), ("Impl", rf"\bimpl\b(?:<[^>]*>)?[ \t]+(?:(?P<trait>[\w:]+)(?:<[^>]*>)?[ \t]+for[ \t]+)?(?P<name>{_NAME})[^{{]*\{{"), ("Function", rf"\bfn[ \t]+(?P<name>{_NAME})[ \t]*(?:<[^>]*>)?{_PARAMS}[^{{;]*\{{")],
    "ruby": [("Class", rf"^[ \t]*(?:class|module)[ \t]+(?P<name>{_NAME})(?P<rest>[^\n]*)"), ("Function", r"^[ \t]*def[ \t]+(?:self\.)?(?P<name>[\w?!]+)[ \t]*(?P<params>\([^)]*\)|[^\n]*)")],
    "php": [*_CLASSES, ("Function", rf"\bfunction[ \t]+&?(?P<name>{_NAME})[ \t]*{_PARAMS}[^{{;]*\{{")],
    "kotlin": [("Type", rf"\binterface[ \t]+(?P<name>{_NAME})(?P<rest>[^{{\n]*)\{{"), ("Class", rf"\b(?:class|object)[ \t]+(?P<name>{_NAME})(?P<rest>[^{{\n]*)"), ("Function", rf"\bfun[ \t]+(?:<[^>]*>[ \t]*)?(?:{_NAME}\.)?(?P<name>{_NAME})[ \t]*{_PARAMS}")],
    "swift": [*_CLASSES, ("Class", rf"\bextension[ \t]+(?P<name>{_NAME})(?P<rest>[^{{]*)\{{"), ("Function", rf"\bfunc[ \t]+(?P<name>{_NAME})[ \t]*(?:<[^>]*>)?{_PARAMS}[^{{\n]*\{{")],
    "zig": [("Class", rf"\bconst[ \t]+(?P<name>{_NAME})[ \t]*=[ \t]*(?:extern[ \t]+|packed[ \t]+)?(?:struct|enum|union)\b[^{{]*\{{"), ("Function", rf"\bfn[ \t]+(?P<name>{_NAME})[ \t]*{_PARAMS}[^{{;]*\{{"), ("Test", r'\btest[ \t]+(?P<name>"[^"]*")[ \t]*\{')],
}
IMPORTS: dict[str, list[str]] = {
    "javascript": [r"\bimport\b(?P<names>[^;'\"]*?)(?:\bfrom[ \t]*)?['\"](?P<module>[^'\"]+)['\"]", r"(?P<names>[^;=\n]*)=[ \t]*require\([ \t]*['\"](?P<module>[^'\"]+)['\"]", r"\bexport\b[^;'\"]*?\bfrom[ \t]*['\"](?P<module>[^'\"]+)['\"]"],
    "java": [r"^[ \t]*import[ \t]+(?:static[ \t]+)?(?P<module>[\w.]+)"], "kotlin": [r"^[ \t]*import[ \t]+(?P<module>[\w.]+)"], "swift": [r"^[ \t]*import[ \t]+(?P<module>[\w.]+)"],
    "csharp": [r"^[ \t]*using[ \t]+(?:static[ \t]+)?(?P<module>[\w.]+)[ \t]*;"], "c": [r"^[ \t]*#[ \t]*include[ \t]*[<\"](?P<module>[^>\"]+)[>\"]"], "go": [r"(?:^[ \t]*import[ \t]+(?:\w+[ \t]+)?|^[ \t]+(?:\w+[ \t]+)?)\"(?P<module>[^\"]+)\"[ \t]*$"],
    "rust": [r"\buse[ \t]+(?P<module>[\w:]+)(?:::\{(?P<names>[^}]*)\})?", r"\bextern[ \t]+crate[ \t]+(?P<module>\w+)"], "ruby": [r"^[ \t]*require(?:_relative)?[ \t(]*['\"](?P<module>[^'\"]+)['\"]"],
    "php": [r"^[ \t]*use[ \t]+(?P<module>[\w\\]+)", r"\b(?:require|include)(?:_once)?[ \t(]*['\"](?P<module>[^'\"]+)['\"]"], "zig": [r"@import\(\"(?P<module>[^\"]+)\"\)"],
}
IMPORTS |= {"typescript": IMPORTS["javascript"], "tsx": IMPORTS["javascript"], "cpp": IMPORTS["c"]}
CONTROL = set("if for while switch catch return else do match loop elif unless until when guard".split())
KEYWORDS = CONTROL | set("function sizeof new await typeof fn func fun def super this self constructor import require in and or not case throw throws assert defined".split())
_CALL = re.compile(r"(?<![\w$])(?P<name>[A-Za-z_$][\w$]*)!?[ \t]*(?:<[\w, <>]*>)?\(")
_JSX = re.compile(r"<(?P<name>[A-Z][\w$]*)[\s/>]")
_ROUTE = re.compile(rf"\.(?:{'|'.join([*ROUTE_METHODS, *LISTENERS])})\((?P<args>[^;]*?)\)\s*;?\s*$", re.M)
_RUNNER = re.compile(rf"\b(?P<runner>{'|'.join(TEST_RUNNERS)})(?:\.\w+)?\(\s*(?P<q>['\"`])(?P<title>[^'\"`]*)(?P=q)")


def mask(text: str, language: str) -> str:
    """Comments and string contents blanked, so that offsets and lines stay."""
    line = "#" if language == "ruby" else "//"
    token = re.compile(rf"{line}[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'" + (r"|`(?:\\.|[^`\\])*`" if language in ("javascript", "typescript", "tsx", "go") else "") + (r"|\#[^\n]*" if language == "php" else ""), re.S)
    if language in ("rust", "zig"):  # ' starts lifetimes too
        token = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", re.S)
    return token.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][:1] not in "\"'`" else m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1], text)


def _close(masked: str, at: int, language: str) -> int:
    """End of the body that starts at or after ``at``."""
    if language == "ruby":
        indent = re.match(r"[ \t]*", masked[masked.rfind("\n", 0, at + 1) + 1 :])[0]
        m = re.compile(rf"^{indent}end\b", re.M).search(masked, at)
        return m.end() if m else len(masked)
    opened = re.compile(r"[{;]").search(masked, at)
    if not opened or opened[0] == ";":
        return opened.end() if opened else masked.find("\n", at) if "\n" in masked[at:] else len(masked)
    depth = 0
    for m in re.compile(r"[{}]").finditer(masked, opened.start()):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(masked)


def _bases(rest: str, language: str) -> list[str]:
    rest = re.sub(r"<[^<>]*>|\([^()]*\)", "", rest or "")
    if language in ("ruby",):
        return re.findall(r"<\s*([\w:]+)", rest)
    parts = re.split(r"\b(?:extends|implements|with|where)\b|:|,", rest)
    return [b for p in parts[1:] if (b := re.sub(r"\b(?:public|private|protected|virtual|final)\b", "", p).strip()) and re.fullmatch(r"[\w.:\\]+", b)]


def read_scanned(path: str, text: str, language: str) -> Facts:
    facts = Facts(path, language, text.count("\n") + 1)
    masked = mask(text, language)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line_of(at: int) -> int:
        import bisect

        return bisect.bisect_right(starts, at)

    found: list[tuple[int, int, Definition]] = []
    impls: list[tuple[int, int, str, str | None]] = []
    heads: set[int] = set()
    for kind, pattern in PATTERNS.get(language, []):
        for m in re.compile(pattern, re.M).finditer(text if kind == "Test" else masked):
            name = m["name"].strip('"')
            if name in CONTROL or m.start("name") in heads:
                continue
            got = m.groupdict()
            at = m.end() - 1 if m[0].endswith("{") else m.end()
            end = _close(masked, at, language) if not (kind == "Class" and language == "c" and m[0].endswith(";")) else m.end()
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            heads.add(m.start("name"))
            if kind == "Impl":
                impls.append((start, end, name, got.get("trait")))
                continue
            params = got.get("params") if got.get("params") is not None else got.get("params2")
            ret = re.search(r"(?:->|\)\s*:)\s*([^{=]+?)\s*(?:\{|=>|$)", masked[m.start() : m.end()])
            sig = "" if params is None else f"({' '.join(params.split()).strip('()')})" + (f" -> {ret[1].strip()}" if ret else "")
            attribute = masked[max(0, masked.rfind("}", 0, start), start - 200) : start]
            test = kind == "Test" or kind == "Function" and (is_test_name(name, path) or bool(re.search(r"#\[(?:\w+::)?test\b|\[(?:Test|Fact|Theory|TestMethod)\b|@Test\b", attribute)))
            found.append((start, end, Definition("Test" if test and kind == "Function" else kind, name, line_of(start), line_of(max(start, end - 1)), text[start:end].encode(), sig, bases=_bases(got.get("rest"), language), owner=got.get("recv") or "", is_test=test)))
    if language in ("javascript", "typescript", "tsx") and is_test_file(path):
        for m in _RUNNER.finditer(text):
            end = text.find("\n", m.end())
            depth = 0
            for p in re.compile(r"[()]").finditer(masked, text.find("(", m.start())):
                depth += 1 if p[0] == "(" else -1
                if depth == 0:
                    end = p.end()
                    break
            name = f"{m['runner']}:{m['title']}"
            found.append((m.start(), end, Definition("Test", name, line_of(m.start()), line_of(max(m.start(), end - 1)), text[m.start() : end].encode(), is_test=True)))
    classes = [(s, e, d) for s, e, d in found if d.kind in ("Class", "Type")]
    for s, e, d in sorted(found, key=lambda x: x[0]):
        if d.kind in ("Function", "Test") and not d.owner:
            around = [(b - a, c.name) for a, b, c in classes if a < s and e <= b] + [(b - a, n) for a, b, n, _ in impls if a < s and e <= b]
            d.owner = min(around)[1] if around else ""
        facts.definitions.append(d)
    for _, _, name, trait in impls:
        if trait:
            for d in facts.definitions:
                if d.name == name and d.kind == "Class":
                    d.bases.append(trait)
    for pattern in IMPORTS.get(language, []):
        for m in re.compile(pattern, re.M).finditer(text):
            got = m.groupdict()
            names = re.findall(_NAME, re.sub(r"\b(?:import|const|let|var|type|as)\b", " ", got.get("names") or "")) or [re.split(r"[.:/\\]+", m["module"])[-1]]
            facts.imports.append((m["module"], names, line_of(m.start("module"))))
    functions = [(s, e) for s, e, d in found if d.kind in ("Function", "Test")]
    inside = lambda at: any(s < at < e for s, e in functions)
    calls = [(m["name"], m.start("name")) for m in _CALL.finditer(masked) if m["name"] not in KEYWORDS and m.start("name") not in heads]
    if language in ("javascript", "typescript", "tsx"):
        calls += [(m["name"], m.start("name")) for m in _JSX.finditer(masked)]
        for m in _ROUTE.finditer(masked):
            last = m["args"].rsplit(",", 1)[-1].strip()
            if re.fullmatch(_NAME, last):
                facts.calls.append((f"\0{last}", line_of(m.start())))
    facts.calls += [(n, line_of(at)) for n, at in calls if inside(at)]
    return facts


def read_vue(path: str, text: str) -> Facts:
    m = re.search(r"(?si)<script([^>]*)>(.*?)</script>", text)
    if not m:
        return Facts(path, "vue", text.count("\n") + 1)
    lang = "typescript" if re.search(r"lang\s*=\s*['\"]tsx?['\"]", m[1]) else "javascript"
    facts = read_scanned(path, m[2], lang)
    shift = text[: m.start(2)].count("\n")
    for d in facts.definitions:
        d.start, d.end = d.start + shift, d.end + shift
    facts.imports = [(a, b, n + shift) for a, b, n in facts.imports]
    facts.calls = [(a, n + shift) for a, n in facts.calls]
    facts.language, facts.n_lines = "vue", text.count("\n") + 1
    return facts


# resolution inside a file ------------------------------------------------------------------
def extract(path: str, content: bytes) -> tuple[list[dict], list[dict]]:
    """(nodes, edges) of one file; an unknown extension gives none."""
    facts = read(path, content)
    return resolve(facts, hashlib.sha256(content).hexdigest()) if facts else ([], [])


def read(path: str, content: bytes) -> Facts | None:
    """What a file says, unresolved; None for an unknown extension."""
    language = language_of_path(path)
    if language is None:
        return None
    text = content.decode("utf8", "replace")
    try:
        return read_python(path, text) if language == "python" else read_vue(path, text) if language == "vue" else read_scanned(path, text, language)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return Facts(path, language, text.count("\n") + 1)


def resolve(f: Facts, file_hash: str) -> tuple[list[dict], list[dict]]:
    test_file = is_test_file(f.path)

    def node(kind, name, qn, start, end, test, doc="", sig="", body=""):
        return {"name": name, "qualified_name": qn, "kind": kind, "file_path": f.path, "line_start": start, "line_end": end, "language": f.language, "is_test": test, "docstring": doc, "signature": sig, "body_hash": body, "file_hash": file_hash}

    nodes = [node("File", f.path, f.path, 1, f.n_lines, test_file, body=file_hash)]
    edges: list[dict] = []

    def edge(source, target, kind, line):
        edges.append({"source_qualified": source, "target_qualified": target, "kind": kind, "file_path": f.path, "line": line})

    by_name: dict[str, str] = {}
    spans: list[tuple[int, int, str]] = []
    types = {d.name for d in f.definitions if d.kind == "Type"}
    for d in f.definitions:
        qn = f"{f.path}::{d.owner}.{d.name}" if d.owner and d.kind in ("Function", "Test", "Type") else f"{f.path}::{d.name}"
        nodes.append(node(d.kind, d.name, qn, d.start, d.end, d.is_test, d.docstring, d.signature, hashlib.sha256(d.body).hexdigest()))
        by_name.setdefault(d.name, qn)
        if d.kind in ("Function", "Test"):
            spans.append((d.start, d.end, qn))
        edge(f"{f.path}::{d.owner}" if d.owner and d.kind != "Class" else f.path, qn, "CONTAINS", d.start)
        for base in d.bases:
            edge(qn, base, "IMPLEMENTS" if re.split(r"[.:\\]+", base)[-1] in types else "INHERITS", d.start)
    brought = {}
    for module, names, line in f.imports:
        edge(f.path, module, "IMPORTS_FROM", line)
        brought |= {n: module for n in names}

    def around(line: int) -> str:
        hits = [(e - s, q) for s, e, q in spans if s <= line <= e]
        return min(hits)[1] if hits else f.path

    for name, line in f.calls:
        source = around(line)
        if name.startswith("\0"):  # a handler passed to a route or listener, at any level
            name = name[1:]
        target = by_name.get(name) or (f"{brought[name]}::{name}" if name in brought else name)
        if target != source:
            edge(source, target, "CALLS", line)
    tests = {n["qualified_name"]: n for n in nodes if n["is_test"] and n["kind"] == "Test"}
    if f.language == "python":
        plain = {n["name"]: n["qualified_name"] for n in nodes if n["kind"] == "Function"}
        for n in tests.values():  # fixtures by parameter name
            for p in re.findall(r"[(,]\s*(\w+)", n["signature"].split("->")[0]):
                if p in plain:
                    edge(n["qualified_name"], plain[p], "CALLS", n["line_start"])
    if test_file:
        linked = set()
        for e in [e for e in edges if e["kind"] == "CALLS" and e["source_qualified"] in tests]:
            pair = (e["target_qualified"], e["source_qualified"])
            if pair not in linked and pair[0] not in tests:
                linked.add(pair)
                edge(*pair, "TESTED_BY", e["line"])
        plain = {n["name"].lower(): n["qualified_name"] for n in nodes if not n["is_test"] and n["kind"] != "File"}
        for qn, n in tests.items():
            short = re.sub(r"^(?:test_|Test|test)", "", n["name"])
            short = re.sub(r"(?:_test|_spec|Test|Spec)$", "", short).lower()
            if short in plain and (plain[short], qn) not in linked:
                edge(plain[short], qn, "TESTED_BY", n["line_start"])
    return nodes, edges


# on Spark -----------------------------------------------------------------------------------
def parse(files: DataFrame, extractor=extract) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges_raw) of (file_path, content, ...); files are independent, so nothing is shuffled.

    node_id orders the nodes of a file by place: a hash of the path above, a running number below.
    """

    ship(files.sparkSession)

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for path, content in zip(frame["file_path"], frame["content"], strict=True):
                nodes, edges = extractor(path, bytes(content))
                high = int.from_bytes(hashlib.sha256(path.encode()).digest()[:5], "big") << 23
                rows.append(([n | {"node_id": high + i} for i, n in enumerate(nodes)], edges))
            yield pd.DataFrame(rows, columns=["nodes", "edges"])

    as_ddl = lambda s: ",".join(f"{x.name}:{x.dataType.simpleString()}" for x in s)
    both = files.select("file_path", "content").mapInPandas(run, f"nodes array<struct<{as_ddl(NODE_SCHEMA)}>>, edges array<struct<{as_ddl(EDGE_SCHEMA)}>>").cache()
    nodes, edges = both.select(F.explode("nodes").alias("x")).select("x.*"), both.select(F.explode("edges").alias("x")).select("x.*")
    nodes._parsed = both
    return nodes, edges


FACTS = """file_path string, language string, n_lines int, file_hash string,
definitions array<struct<ordinal: long, kind: string, name: string, owner: string, line_start: int, line_end: int, is_test: boolean, signature: string, docstring: string, body_hash: string, bases: array<string>>>,
imports array<struct<ordinal: long, module: string, names: array<string>, line: int>>,
calls array<struct<ordinal: long, name: string, line: int>>"""


def read_facts(files: DataFrame) -> tuple[DataFrame, FileFacts]:
    """(files, fact tables) of (file_path, content, ...), for the joins of ``operators.resolution``."""
    ship(files.sparkSession)

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for path, content in zip(frame["file_path"], frame["content"], strict=True):
                content = bytes(content)
                if (f := read(path, content)) is None:
                    continue
                definitions = [{"ordinal": i, "kind": d.kind, "name": d.name, "owner": d.owner, "line_start": d.start, "line_end": d.end, "is_test": d.is_test, "signature": d.signature, "docstring": d.docstring, "body_hash": hashlib.sha256(d.body).hexdigest(), "bases": d.bases} for i, d in enumerate(f.definitions)]
                imports = [{"ordinal": i, "module": m, "names": n, "line": line} for i, (m, n, line) in enumerate(f.imports)]
                calls = [{"ordinal": i, "name": n.lstrip("\0"), "line": line} for i, (n, line) in enumerate(f.calls)]
                rows.append((f.path, f.language, f.n_lines, hashlib.sha256(content).hexdigest(), definitions, imports, calls))
            yield pd.DataFrame(rows, columns=["file_path", "language", "n_lines", "file_hash", "definitions", "imports", "calls"])

    facts = files.select("file_path", "content").mapInPandas(run, FACTS).cache()
    part = lambda name, *with_: facts.select("file_path", *with_, F.explode(name).alias("x")).select("file_path", *with_, "x.*")
    read_files = facts.drop("definitions", "imports", "calls")
    read_files._parsed = facts
    return read_files, FileFacts(part("definitions", "language"), part("imports"), part("calls"))


def release(nodes: DataFrame) -> None:
    """Drop what ``parse`` keeps for its two results, once both are written."""
    if getattr(nodes, "_parsed", None) is not None:
        nodes._parsed.unpersist()


def build(files: DataFrame):
    """The graph of scanned files, with names resolved by joins; equals what ``parse`` gives file by file."""
    return graph_of(*read_facts(files))
