"""Path aliases of JavaScript projects: configuration files with comments, ``extends`` and wildcards."""

from __future__ import annotations

import json
import os
import re

PROBES = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js"]


def loads(text: str) -> dict:
    """JSON with comments and trailing commas."""
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return json.loads(re.sub(r",(\s*[}\]])", r"\1", text))


def aliases(path: str, seen: frozenset[str] = frozenset()) -> dict[str, list[str]]:
    """Pattern -> absolute targets; what a file says goes before what it extends."""
    path = os.path.abspath(path)
    if path in seen or not os.path.isfile(path):
        return {}
    with open(path, encoding="utf8") as f:
        config = loads(f.read())
    out: dict[str, list[str]] = {}
    if parent := config.get("extends"):
        parent = os.path.join(os.path.dirname(path), parent)
        out |= aliases(parent if parent.endswith(".json") else parent + ".json", seen | {path})
    options = config.get("compilerOptions", {})
    base = os.path.join(os.path.dirname(path), options.get("baseUrl", "."))
    return out | {k: [os.path.normpath(os.path.join(base, t)) for t in v] for k, v in options.get("paths", {}).items()}


def resolve(module: str, table: dict[str, list[str]], exists=os.path.isfile) -> str | None:
    """The file an import means, by the first pattern and target that lead to one."""
    for pattern, found in table.items():
        head, star, tail = pattern.partition("*")
        if star and not (module.startswith(head) and module.endswith(tail) and len(module) >= len(head) + len(tail)) or not star and module != pattern:
            continue
        middle = module[len(head) : len(module) - len(tail)] if star else ""
        for target in found:
            for probe in PROBES:
                if exists(path := target.replace("*", middle, 1) + probe):
                    return path
    return None
