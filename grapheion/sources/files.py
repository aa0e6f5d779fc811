"""Source files: listing, filters, language, hashes."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Which files are read, and as what.
EXTENSIONS = {
    "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "mts": "typescript",
    "cts": "typescript", "tsx": "tsx", "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp",
    "hpp": "cpp", "hxx": "cpp", "hh": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "kt": "kotlin", "kts": "kotlin", "swift": "swift",
    "zig": "zig", "zon": "zig", "vue": "vue",
}
IGNORED = """
node_modules/** .git/** __pycache__/** *.pyc .venv/** venv/** dist/** build/** .next/** target/** *.min.js *.min.css *.map *.lock
package-lock.json yarn.lock *.db *.sqlite *.db-journal *.db-wal
""".split()
# End of fixed values.
STORE_DIR = ".grapheion"
IGNORE_FILE = ".grapheionignore"
SNIFF_BYTES = 8192


def glob_regex(pattern: str) -> str:
    """A plain glob over a relative path: * and ? match within and across folders alike."""
    out = ""
    for c in re.split(r"(\*+|\?)", pattern):
        out += ".*" if c.startswith("*") else "." if c == "?" else re.escape(c).replace("/", "/")
    return f"^{out}$"


def ignore_patterns(root: str) -> list[str]:
    patterns = [f"{STORE_DIR}/**", *IGNORED]
    path = os.path.join(root, IGNORE_FILE)
    if os.path.exists(path):
        with open(path, encoding="utf8") as f:
            patterns += [x for x in map(str.strip, f) if x and not x.startswith("#")]
    return patterns


def is_ignored(relative: Column, patterns: list[str]) -> Column:
    return relative.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)) if patterns else F.lit(False)


def language_of(path: Column) -> Column:
    """Language key by extension, null if unknown."""
    ext = F.lower(F.regexp_extract(path, r"[^/\\]\.([^./\\]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(table, ext)


def is_binary(content: Column) -> Column:
    """A zero byte among the first 8 KiB."""
    return F.contains(F.substring(content, 1, SNIFF_BYTES), F.lit(bytearray(1)))


def listed(root: str, tracked: list[str] | None = None) -> list[str]:
    """Relative paths below root: what version control tracks, else a walk; links are left out."""
    if tracked is None:
        tracked = [os.path.relpath(os.path.join(d, n), root) for d, dirs, names in os.walk(root) if not dirs.sort() for n in names]
    return [p.replace(os.sep, "/") for p in tracked if os.path.isfile(os.path.join(root, p)) and not os.path.islink(os.path.join(root, p))]


def scan(spark: SparkSession, root: str, tracked: list[str] | None = None) -> DataFrame:
    """(file_path, content, language, file_hash, n_bytes) of source files below a folder that executors can read.

    Names are filtered on the driver by listing only; contents are read by the executors.
    """
    patterns = [re.compile(glob_regex(p)) for p in ignore_patterns(root)]
    names = [p for p in listed(root, tracked) if not any(r.match(p) for r in patterns) and p.rsplit(".", 1)[-1].lower() in EXTENSIONS and "." in p]
    schema = "file_path string, content binary, language string, file_hash string, n_bytes long"
    if not names:
        return spark.createDataFrame([], schema)
    prefix = "file:" + os.path.abspath(root).rstrip("/") + "/"
    raw = spark.read.format("binaryFile").load([f"file://{os.path.abspath(root)}/{n}" for n in names])
    path = F.substring_index("path", prefix, -1)
    rows = raw.select(path.alias("file_path"), "content", F.col("length").alias("n_bytes")).filter(~is_binary(F.col("content")))
    return rows.select("file_path", "content", language_of(F.col("file_path")).alias("language"), F.sha2("content", 256).alias("file_hash"), "n_bytes").filter("language is not null")


def lines_of(files: DataFrame) -> DataFrame:
    """(file_path, line_no, text) from (file_path, content), numbered from 1."""
    text = F.decode("content", "UTF-8")
    return files.select("file_path", F.posexplode(F.split(text, "\r?\n")).alias("p", "text")).select("file_path", (F.col("p") + 1).alias("line_no"), "text")
