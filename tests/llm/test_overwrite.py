"""Late arrivals: the whole query and small tables against a plain version, bytes of clean files, writers that meet or die."""

import hashlib
import math
import os
import zlib
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest

from grapheion.llm import overwrite
from grapheion.llm.overwrite import DatedTable
from grapheion.sources.commits import Conflict

SF = "/root/testdata/sf0.01"
CUT = datetime(2024, 3, 20)
EPOCH = datetime(1970, 1, 1)
SCHEMA = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"


def micros(t):
    return "" if t is None else (t - EPOCH) // timedelta(microseconds=1)


def day(t):
    return -1 if t is None else (t - EPOCH).days


def copies(rows):
    for r in rows:
        yield r
        h = zlib.crc32(str(r["sale_id"]).encode())
        if r["sale_id"] is not None and h % 3 == 0 and day(r["sold_at"]) % 4 == 0:
            late = r["arrived_at"] and r["arrived_at"] + timedelta(days=1 + h % 97)
            yield r | {"total": None if r["total"] is None else r["total"] + 1, "sold_at": r["sold_at"] + timedelta(days=h % 2), "arrived_at": late}


def layout(rows, size):
    """{day: [rows of a file, ...]} and the kept row of each sale."""
    kept = {}
    for r in rows:
        old = kept.get(r["sale_id"])
        if old is None or (r["arrived_at"] or datetime.min) > (old["arrived_at"] or datetime.min):
            kept[r["sale_id"]] = r
    days = {}
    for r in kept.values():
        days.setdefault(day(r["sold_at"]), []).append(r)
    out = {}
    for d, part in days.items():
        part.sort(key=lambda r: (r["sold_at"] or datetime.min, -1 if r["sale_id"] is None else r["sale_id"]))
        out[d] = [part[i : i + size] for i in range(0, len(part), size)]
    return out, kept


def brute(sales):
    size = 1 + len(sales) // 1100
    rows = list(copies(sales))
    is_early = lambda r: r["arrived_at"] is not None and r["arrived_at"] < CUT
    _, start = layout(filter(is_early, rows), size)
    final, kept = layout(rows, size)
    dirty = set()
    for k, r in kept.items():
        if not is_early(r):
            dirty |= {day(r["sold_at"])} | ({day(start[k]["sold_at"])} if k in start else set())
    for d, files in final.items():
        for i, part in enumerate(files):
            text = ",".join("" if r["sale_id"] is None else str(r["sale_id"]) for r in part)
            crc = sum(zlib.crc32(f"{'' if r['sale_id'] is None else r['sale_id']}:{micros(r['sold_at'])}:{micros(r['arrived_at'])}".encode()) for r in part)
            cents = sum(math.floor(100 * r["total"] + 0.5) for r in part if r["total"] is not None)
            yield (d, i, len(part), cents, crc, "sale_id,client_id,status,total,sold_at,arrived_at,priority", hashlib.sha256(text.encode()).hexdigest(), d in dirty)


def test_query_equals_plain_version(spark):
    got = overwrite.op13_late_overwrite(spark, SF).collect()
    want = sorted(brute(pq.read_table(f"{SF}/sales.parquet").to_pylist()))
    assert sorted((r.day, r.file_no, r.n_rows, r.cents, r.rows_crc, r.columns, r.ids_sha256, r.rewritten) for r in got) == want
    assert 0 < sum(r.rewritten for r in got) < len(got)
    top = got[0].path.split("/data/")[0].removeprefix("file://")
    left = {os.path.join(d, f) for d, _, names in os.walk(top) for f in names if f.endswith(".parquet") and "/data/" in d}
    assert left == {r.path.removeprefix("file://") for r in got}
    assert not os.path.exists(f"{top}/unfinished") or not any(n for _, _, n in os.walk(f"{top}/unfinished"))


def at(text):
    return datetime.fromisoformat(text) if text else None


def rows_of(*specs):
    return [(k, 1, "s", total, at(sold), at(arrived), 1) for k, total, sold, arrived in specs]


@pytest.fixture
def stored(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    return DatedTable(spark, f"file://{tmp_path}/t", schema, "sale_id", "sold_at", "arrived_at", 2)


EARLY = rows_of((1, 1.0, "2024-01-01", "2024-01-02"), (2, 2.0, "2024-01-01T05:00", "2024-01-02"), (3, 3.0, "2024-01-01T01:00", "2024-01-02"), (4, None, None, "2024-01-02"), (None, 5.0, "2024-01-02", None), (6, 6.0, "2024-01-03", "2024-01-03"), (6, 6.0, "2024-01-03", "2024-01-03"), (6, 5.0, "2024-01-05", "2024-01-02"))
LATE = rows_of((2, 9.0, "2024-01-02T05:00", "2024-04-01"), (6, 7.0, "2024-01-04", "2024-01-01"), (7, 7.0, "2024-01-04", "2024-04-01"), (7, 8.0, "1969-12-30", "2024-04-02"))


def by_file(t):
    return {(r.layout_day, r.file_no): (r.path, r.n_rows, hashlib.sha256(open(r.path.removeprefix("file://"), "rb").read()).hexdigest()) for r in t.manifest().collect()}


def test_only_touched_days_are_rewritten(spark, stored):
    stored.create(spark.createDataFrame(EARLY, SCHEMA).repartition(3))
    first = by_file(stored)
    assert {k: v[1] for k, v in first.items()} == {(-1, 0): 1, (19723, 0): 2, (19723, 1): 1, (19724, 0): 1, (19725, 0): 1}
    stored.overwrite(spark.createDataFrame(LATE, SCHEMA))
    second = by_file(stored)
    assert {k: v[1] for k, v in second.items()} == {(-1, 0): 1, (-2, 0): 1, (19723, 0): 2, (19724, 0): 2, (19725, 0): 1}
    assert {k for k in second if second[k] == first.get(k)} == {(-1, 0), (19725, 0)}
    kept = sorted(((r.sale_id or 0), r.total or 0.0) for r in stored.read().collect())
    assert kept == [(0, 5.0), (1, 1.0), (2, 9.0), (3, 3.0), (4, 0.0), (6, 6.0), (7, 8.0)]
    # the same rows again change nothing
    stored.overwrite(spark.createDataFrame(LATE, SCHEMA))
    assert by_file(stored) == second and stored.generation() == 2


def test_a_day_may_become_empty_and_tables_may_be(spark, stored):
    stored.create(spark.createDataFrame([], SCHEMA))
    assert stored.read().count() == 0 and by_file(stored) == {}
    stored.overwrite(spark.createDataFrame(rows_of((1, 1.0, "2024-01-01", "2024-01-01")), SCHEMA))
    stored.overwrite(spark.createDataFrame(rows_of((1, 2.0, "2024-02-01", "2024-01-05")), SCHEMA))
    assert set(by_file(stored)) == {(19754, 0)} and stored.vacuum() == 0
    stored.overwrite(spark.createDataFrame([], SCHEMA))
    assert [r.total for r in stored.read().collect()] == [2.0]


def test_two_writers_and_one_that_dies(spark, stored, monkeypatch):
    stored.create(spark.createDataFrame(EARLY, SCHEMA))
    before = by_file(stored)
    other = DatedTable(spark, stored.folder, stored.schema, "sale_id", "sold_at", "arrived_at", 2)
    commit = stored._commits.commit
    # the other writer commits between this one's files and its commit
    monkeypatch.setattr(stored._commits, "commit", lambda n, t: (other.overwrite(spark.createDataFrame(LATE, SCHEMA)), commit(n, t)))
    with pytest.raises(Conflict):
        stored.overwrite(spark.createDataFrame(rows_of((3, 8.0, "2024-01-01", "2024-05-01")), SCHEMA))
    assert stored.generation() == 1 and stored.vacuum() == 0
    after = by_file(stored)

    def dies(n, t):
        raise OSError("gone")

    monkeypatch.setattr(stored._commits, "commit", dies)
    with pytest.raises(OSError):
        stored.overwrite(spark.createDataFrame(rows_of((3, 8.0, "2024-01-01", "2024-05-01")), SCHEMA))
    assert by_file(other) == after != before and sorted(r.total for r in other.read().collect() if r.sale_id == 3) == [3.0]
    assert other.vacuum() == 1 and by_file(other) == after
    other.overwrite(spark.createDataFrame(rows_of((3, 8.0, "2024-01-01", "2024-05-01")), SCHEMA))
    assert [r.total for r in other.read().filter("sale_id = 3").collect()] == [8.0]


def test_clashing_columns_and_sessions_zone(spark, tmp_path):
    schema = "sale_id long, layout_day string, sold_at timestamp, arrived_at timestamp, `k` int, row int, layout_gen int"
    rows = [(1, "x", at("2024-01-01T12:00"), at("2024-01-02"), 1, 2, 3), (1, "y", at("2024-01-01T12:00"), at("2024-01-02"), 0, 0, 0)]
    df = spark.createDataFrame(rows, schema)
    t = DatedTable(spark, f"file://{tmp_path}/t", df.schema, "sale_id", "sold_at", "arrived_at", 10)
    t.create(df)
    assert [tuple(r)[:2] + tuple(r)[4:] for r in t.read().collect()] == [(1, "y", 0, 0, 0)]
    assert pq.read_schema(next(iter(by_file(t).values()))[0].removeprefix("file://")).names == df.columns


def test_hot_day_is_cut_in_order(spark, stored):
    """Half of the rows on one day, at one time."""
    rows = rows_of(*[(i, 1.0, "2024-01-01" if i % 2 else f"2024-01-{1 + i % 28:02d}", "2024-01-01") for i in range(999)])
    stored.create(spark.createDataFrame(rows, SCHEMA).repartition(5))
    ids = [pq.read_table(p.removeprefix("file://"))["sale_id"].to_pylist() for (d, _), (p, _, _) in sorted(by_file(stored).items()) if d == 19723]
    assert sum(ids, []) == sorted(sum(ids, [])) and {len(x) for x in ids[:-1]} == {2}
