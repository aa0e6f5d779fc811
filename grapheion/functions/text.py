"""Query analysis and string functions, on the driver and as columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these lists and numbers being exactly so.
STOP_WORDS = """
a an the in on at to for is it of and or not with from by as be was that this which when where how what who why does
do did has have had can could will would should may might are were been being into after before between through during
about than both each all any some most other such only very more also just so up out if then but its no because instead
due via using causes cause causing breaks break fails fail returns return incorrectly correctly
""".split()
SOURCE_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".rs", ".go", ".py", ".java", ".kt", ".swift", ".rb", ".cs", ".php", ".cpp", ".c", ".h", ".vue", ".svelte", ".toml", ".yaml", ".yml", ".json"]
COMPOUND_TERMS = [
    "race condition", "memory leak", "stack overflow", "null pointer", "off by one", "content length", "status code", "error message",
    "return type", "dead lock", "deadlock", "buffer overflow", "integer overflow", "use after free", "double free", "type error",
    "syntax error", "import cycle", "circular dependency", "infinite loop", "out of bounds", "index out of bounds", "key error",
    "value error", "name error", "attribute error", "connection refused", "timeout error", "parse error", "compile error", "link error",
]
ERROR_PREFIXES = """
typeerror: syntaxerror: valueerror: referenceerror: rangeerror: nameerror: attributeerror: keyerror: indexerror: importerror:
runtimeerror: oserror: ioerror: connectionerror: timeouterror: overflowerror: zerodivisionerror: filenotfounderror:
permissionerror: error: exception: panic: fatal: failed: error[e
""".split()
TRACE_INDICATORS = ["traceback", "at line ", "  at ", "caused by:", "note: ", "assertion failed", "thread '", "stack trace:"]
CONFIG_TERMS = ["config", "option", "setting", "experimental", "flag", "enable", "disable"]
TEST_WORDS = ["test", "spec", "fixture", "mock", "assert"]
CAUSAL_STARTS = ["why ", "how does ", "where does ", "what causes "]
CAUSAL_PARTS = ["included in", "loaded by"]
ROUTES = {"ExactSymbol": "exact_symbol_match", "FilePath": "filepath_match", "ExactText": "exact_text_match", "ConfigLookup": "config_match", "Causal": "causal_query", "General": "general"}
# End of fixed values.


@dataclass
class Parts:
    """A query in typed buckets."""

    raw: str
    symbols: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)
    quoted: list[str] = field(default_factory=list)
    compounds: list[str] = field(default_factory=list)
    mentions_tests: bool = False


_QUOTED = re.compile(r'"([^"]*)"|`([^`]*)`')
_EDGE = re.compile(r"^[^\w/.]+|[^\w/.]+$")


def quoted_spans(query: str) -> list[str]:
    """Trimmed, non-empty contents of "..." and `...` spans, in order."""
    return [s for m in _QUOTED.finditer(query) if (s := (m[1] if m[1] is not None else m[2]).strip())]


def compound_terms(tokens: list[str]) -> list[str]:
    padded = f" {' '.join(tokens)} "
    return [t for t in COMPOUND_TERMS if f" {t} " in padded]


def decompose(query: str) -> Parts:
    """Symbols (mixed case, underscores, capitals), path fragments, remaining terms, quoted spans, compound terms."""
    parts = Parts(query, quoted=quoted_spans(query))
    rest = query
    for span in parts.quoted:
        rest = rest.replace(f'"{span}"', " ").replace(f"`{span}`", " ")
    plain = []
    for token in filter(None, (_EDGE.sub("", t) for t in rest.split())):
        lower = token.lower()
        parts.mentions_tests |= any(w in lower for w in TEST_WORDS)
        upper, small = any(map(str.isupper, token)), any(map(str.islower, token))
        if "/" in token or lower.endswith(tuple(SOURCE_EXTENSIONS)):
            parts.paths.append(token)
        elif "_" in token or upper and (small or len(token) >= 2):
            parts.symbols.append(token)
            plain.append(lower)
        elif lower not in STOP_WORDS:
            parts.terms.append(lower)
            plain.append(lower)
    parts.compounds = compound_terms(plain)
    return parts


def passthrough(query: str) -> Parts:
    """Every token a term; nothing classified."""
    tokens = (_EDGE.sub("", t).lower() for t in query.split())
    return Parts(query, terms=[t for t in tokens if t and t not in STOP_WORDS])


def relaxed_words(query: str) -> list[str]:
    words = (re.sub(r"^[\W_]+|[\W_]+$", "", w.lower()) for w in query.split())
    return [w for w in words if w and w not in STOP_WORDS]


@dataclass
class Classified:
    route: str
    confidence: float
    signals: dict[str, bool]


def classify(query: str) -> Classified:
    """Route and confidence; the first rule that holds decides."""
    q = query.strip()
    lower, words = q.lower(), q.split()
    one = words[0] if len(words) == 1 else ""
    signals = {
        "has_quoted_span": bool(quoted_spans(q)),
        "has_error_text": lower.startswith(tuple(ERROR_PREFIXES)) or any(t in lower for t in TRACE_INDICATORS),
        "has_path_hint": "/" in q or any(e in q for e in SOURCE_EXTENSIONS),
        "has_identifier_hint": "_" in one or any(map(str.isupper, one)) and any(map(str.islower, one)),
    }
    n = sum(t in lower for t in CONFIG_TERMS)
    rules = [
        (signals["has_identifier_hint"], "ExactSymbol", 0.9),
        (signals["has_quoted_span"], "ExactText", 0.85),
        (signals["has_error_text"], "ExactText", 0.8),
        (signals["has_path_hint"], "FilePath", 0.85),
        (lower.startswith(tuple(CAUSAL_STARTS)) or any(p in lower for p in CAUSAL_PARTS), "Causal", 0.8),
        (n >= 2, "ConfigLookup", 0.75),
        (n == 1 and len(words) <= 4, "ConfigLookup", 0.6),
    ]
    route, confidence = next(((r, c) for holds, r, c in rules if holds), ("General", 0.5))
    return Classified(route, confidence, signals)


def any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def classified_columns(text: Column) -> tuple[Column, Column]:
    """(route, confidence) of a column of queries; the rules of ``classify`` in one CASE."""
    q = F.trim(text)
    lower = F.lower(q)
    words = F.filter(F.split(q, r"\s+"), lambda w: w != "")
    quoted = F.exists(F.concat(F.regexp_extract_all(q, F.lit('"([^"]*)"'), 1), F.regexp_extract_all(q, F.lit("`([^`]*)`"), 1)), lambda s: F.trim(s) != "")
    error = any_of([lower.startswith(p) for p in ERROR_PREFIXES] + [lower.contains(t) for t in TRACE_INDICATORS])
    path = any_of([q.contains(e) for e in [*SOURCE_EXTENSIONS, "/"]])
    name = (F.size(words) == 1) & (q.rlike("[A-Z]") & q.rlike("[a-z]") | q.contains("_"))
    causal = any_of([lower.startswith(s) for s in CAUSAL_STARTS] + [lower.contains(s) for s in CAUSAL_PARTS])
    hits = sum((lower.contains(t).cast("int") for t in CONFIG_TERMS), F.lit(0))
    rules = [(name, "ExactSymbol", 0.9), (quoted, "ExactText", 0.85), (error, "ExactText", 0.8), (path, "FilePath", 0.85), (causal, "Causal", 0.8), (hits >= 2, "ConfigLookup", 0.75), ((hits == 1) & (F.size(words) <= 4), "ConfigLookup", 0.6)]
    route, confidence = F.lit("General"), F.lit(0.5)
    for holds, r, c in reversed(rules):
        route, confidence = F.when(holds, r).otherwise(route), F.when(holds, c).otherwise(confidence)
    return route, confidence


def normalize_path(path: Column) -> Column:
    """Slashes forward, no extended-length prefix, no trailing slash."""
    p = F.regexp_replace(path, r"^(\\\\\?\\|//\?/)", "")
    return F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), "/+$", "")


def normalize_qualified(name: Column) -> Column:
    """The path rules on what stands before the first ``::`` only."""
    at = F.instr(name, "::")
    return F.when(at > 0, F.concat(normalize_path(F.substring(name, F.lit(1), at - 1)), F.substring(name, at, F.length(name)))).otherwise(normalize_path(name))


def relative_path(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)


def mask_key(key: str) -> str:
    """A secret for display: its first and last three characters."""
    return f"{key[:3]}***{key[-3:]}" if len(key) > 8 else "***"


def node_text(name: Column, kind: Column, signature: Column, language: Column) -> Column:
    """What a node's embedding is made from: non-empty parts joined by spaces."""
    return F.array_join(F.filter(F.array(name, kind, signature, language), lambda x: x != ""), " ")


def matched_terms(symbols: list[str], terms: list[str], *haystacks: Column) -> Column:
    """The query's symbols and terms that occur in any of the columns."""
    listed = F.array(*[F.lit(t) for t in [*symbols, *terms]]) if symbols or terms else F.array().cast("array<string>")
    return F.filter(listed, lambda t: any_of([F.lower(h).contains(F.lower(t)) for h in haystacks]))
