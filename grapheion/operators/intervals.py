"""Overlap joins of intervals by cells: no pair is compared that lies far apart.

Every interval is entered at the narrowest of a few widths that hold it, in the one or two cells of
that width it touches, and looks into the cells of all wider ones that the other side uses. Of two
that overlap the narrower finds the wider in the cell where their overlap begins; only that cell
counts the pair, so each is found once and nothing has to be removed. The join's key is (file,
width, cell): a file of any number of intervals is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Widths of cells, each four times the one before; the last holds any pair of 32-bit places.
WIDTHS = [8 * 4**i for i in range(15)]


def _level(length: Column) -> Column:
    out = F.lit(len(WIDTHS) - 1)
    for i in range(len(WIDTHS) - 2, -1, -1):
        out = F.when(length <= WIDTHS[i], i).otherwise(out)
    return out


def _width(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w).cast("long") for w in WIDTHS]), level + 1)


def _cells(df: DataFrame, side: str, levels: Column) -> DataFrame:
    """A row for each of the cells that an interval touches at ``levels``."""
    lo, hi = (F.col(f"{side}_{x}").cast("long") for x in ("lo", "hi"))
    at = df.withColumn("_level", F.explode(levels))
    w = _width(F.col("_level"))
    return at.withColumn("_cell", F.explode(F.array_distinct(F.array(F.floor(lo / w), F.floor(hi / w)))))


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of (file, a_start, a_end, ...) and (file, b_start, b_end, ...) that share a place.

    Other columns must differ by name. Null files or places meet nothing. An interval that ends
    before it starts meets those that hold both of its ends.
    """

    def entered(df: DataFrame, side: str) -> DataFrame:
        lo, hi = F.least(f"{side}_start", f"{side}_end"), F.greatest(f"{side}_start", f"{side}_end")
        fine = F.col("file").isNotNull() & F.col(f"{side}_start").isNotNull() & F.col(f"{side}_end").isNotNull()
        return df.filter(fine).withColumns({f"{side}_lo": lo, f"{side}_hi": hi}).withColumn(f"{side}_level", _level(hi.cast("long") - lo.cast("long") + 1))

    a, b = entered(a, "a"), entered(b, "b")
    used = {side: sorted(r[0] for r in df.select(f"{side}_level").distinct().collect()) for side, df in (("a", a), ("b", b))}  # at most 15 numbers each

    def found(wide: DataFrame, narrow: DataFrame, ws: str, ns: str, same: bool) -> DataFrame:
        """Pairs whose first is at the wider level, or at the same where ``same``."""
        mine = F.col(f"{ns}_level")
        above = F.filter(F.array(*map(F.lit, used[ws] or [0])), lambda x: x >= mine if same else x > mine)
        left, right = _cells(wide, ws, F.array(f"{ws}_level")), _cells(narrow, ns, above)
        begins = F.floor(F.greatest(F.col("a_lo"), F.col("b_lo")).cast("long") / _width(F.col("_level")))
        exact = (F.col("a_start") <= F.col("b_end")) & (F.col("a_end") >= F.col("b_start"))
        return left.join(right, ["file", "_level", "_cell"]).filter((F.col("_cell") == begins) & exact)

    drop = ["_level", "_cell", *[f"{s}_{x}" for s in "ab" for x in ("lo", "hi", "level")]]
    one, two = found(a, b, "a", "b", True).drop(*drop), found(b, a, "b", "a", False).drop(*drop)
    return one.unionByName(two.select(*one.columns))
