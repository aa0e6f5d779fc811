"""What version control knows: tracked files, changes, diff ranges."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TIMEOUT_SETTING, TIMEOUT_SECONDS = "GRAPHEION_GIT_TIMEOUT", 30


def run(root: str, *args: str) -> str:
    """Standard output of a git command; empty if it fails without any, or takes too long."""
    try:
        limit = float(os.environ.get(TIMEOUT_SETTING, TIMEOUT_SECONDS))
        return subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=limit).stdout.decode("utf8", "replace")
    except (OSError, subprocess.TimeoutExpired):
        return ""


def _lines(out: str) -> list[str]:
    return [x for x in out.splitlines() if x.strip()]


def tracked(root: str) -> list[str] | None:
    """Tracked paths, or None where there is no repository."""
    return _lines(run(root, "ls-files")) or None


def changed(root: str, base: str = "HEAD~1") -> list[str]:
    return _lines(run(root, "diff", "--name-only", base)) or _lines(run(root, "diff", "--name-only", "--cached"))


def parse_status(out: str) -> list[str]:
    """Paths of porcelain status lines; a rename counts under its new name."""
    return [line[3:].split(" -> ")[-1].strip('"') for line in out.splitlines() if len(line) > 3]


def status(root: str) -> list[str]:
    return parse_status(run(root, "status", "--porcelain"))


def diff_text(root: str, base: str = "HEAD~1") -> str:
    return run(root, "diff", "--unified=0", base)


def changed_or_status(root: str, given: list[str] | None = None, base: str = "HEAD~1") -> list[str]:
    return given or changed(root, base) or status(root)


def hunks(lines: DataFrame) -> DataFrame:
    """(file, start, end) on the new side of diffs given as (diff_id, line_no, text).

    A hunk without a count is one line; a count of zero (pure removal) is dropped.
    """
    header = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    kept = lines.filter(F.col("text").rlike(r"^(\+\+\+ |@@ )"))
    name = F.when(F.col("text").startswith("+++ "), F.regexp_replace(F.substring(F.col("text"), F.lit(5), F.length("text")), "^b/", ""))
    by = Window.partitionBy("diff_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = kept.withColumn("file", F.last(name, ignorenulls=True).over(by)).filter(F.col("text").startswith("@@"))
    count = F.regexp_extract("text", header, 2)
    rows = rows.select("file", F.regexp_extract("text", header, 1).cast("int").alias("start"), F.when(count == "", 1).otherwise(count.cast("int")).alias("n"))
    return rows.filter((F.col("n") > 0) & (F.col("file") != "/dev/null")).select("file", "start", (F.col("start") + F.col("n") - 1).alias("end"))


def diff_ranges(spark: SparkSession, root: str, base: str = "HEAD~1") -> DataFrame:
    rows = [(0, i, x) for i, x in enumerate(diff_text(root, base).splitlines())]
    return hunks(spark.createDataFrame(rows, "diff_id int, line_no int, text string"))
