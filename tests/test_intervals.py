"""Validity intervals: from any number of scans at once, merged scan by scan, and read as of any date."""

import random

import pytest

from custos.operators import intervals as V

KEY, VALUES = ["asset_id", "field"], ["kind", "size"]
DDL = "asset_id bigint, field string, kind string, size int"
SCANS = [f"2020-0{i}-01" for i in range(1, 9)]


def observations(seed=1):
    """Rows of each scan: keys come, go, return and change; nulls in keys and values; the fifth scan sees nothing."""
    rng = random.Random(seed)
    keys = [(a, f) for a in (1, 2, 3, None) for f in ("x", "y", None)]
    out = []
    for scan in SCANS:
        for k in keys if scan != SCANS[4] else []:
            if rng.random() < 0.7:
                out.append((*k, rng.choice(["INT", "INT", "BIGINT", None]), rng.choice([1, 1, None]), scan))
    return out


def brute(rows):
    """Intervals by walking through each key's scans."""
    seen = {}
    for a, f, k, s, scan in rows:
        seen.setdefault((a, f), {})[scan] = (k, s)
    out = []
    for key, by in seen.items():
        start = None
        for i, scan in enumerate(SCANS):
            now = by.get(scan)
            if start is None and scan in by:
                start = scan
            nxt = SCANS[i + 1] if i + 1 < len(SCANS) else None
            if start is not None and (nxt is None or nxt not in by or by[nxt] != now):
                out.append((*key, *by[scan], start, nxt))
                start = None
    return out


def listed(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


COLUMNS = [*KEY, *VALUES, "valid_from", "valid_to"]


@pytest.fixture(scope="module")
def scans(spark):
    return spark.createDataFrame([(s,) for s in SCANS], "scan string")


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals_of_all_scans(spark, scans, seed):
    rows = observations(seed)
    history = V.from_scans(spark.createDataFrame(rows + rows[:5], f"{DDL}, scan string"), scans, KEY, VALUES)
    assert listed(history, COLUMNS) == sorted(brute(rows), key=repr)
    for when in ("2019-12-31", "2020-03-15", SCANS[4], SCANS[7], "2099-01-01"):
        last = max((s for s in SCANS if s <= when), default=None)
        assert listed(V.as_of(history, when), [*KEY, *VALUES]) == sorted([r[:4] for r in rows if r[4] == last], key=repr)


def test_changes_between_scans(spark, scans):
    rows = observations(1)
    history = V.from_scans(spark.createDataFrame(rows, f"{DDL}, scan string"), scans, KEY, VALUES)
    at = {s: {r[:2]: r[2:4] for r in rows if r[4] == s} for s in SCANS}
    want = []
    for a, b in zip(SCANS, SCANS[1:]):
        for k in set(at[a]) | set(at[b]):
            x, y = at[a].get(k), at[b].get(k)
            if x != y:
                want.append((*k, b, "added" if x is None else "removed" if y is None else "changed", x, y))
    got = [(r.asset_id, r.field, r["at"], r.change, r.before and tuple(r.before), r.after and tuple(r.after))
           for r in V.changes(history, KEY, VALUES).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_row_meets_what_was_valid_at_its_time(spark, scans):
    rows = observations(2)
    history = V.from_scans(spark.createDataFrame(rows, f"{DDL}, scan string"), scans, KEY, VALUES)
    asked = [(i, a, f, day) for i, (a, f, day) in enumerate((a, f, d) for a in (1, None, 9) for f in ("x", None)
                                                            for d in ("2020-01-01", "2020-02-20", "2020-05-01", "2021-01-01", "2010-01-01"))]
    got = V.as_of_join(spark.createDataFrame(asked, "n int, asset_id bigint, field string, day string"), history, KEY, "day").collect()
    known = {(a, f, s): (k, z) for a, f, k, z, s in rows}
    want = {n: known.get((a, f, max((s for s in SCANS if s <= day), default=None)), (None, None)) for n, a, f, day in asked}
    assert {r.n: (r.kind, r["size"]) for r in got} == want and len(got) == len(asked)


def table(spark, tmp_path, name="h"):
    return V.HistoryTable(spark, str(tmp_path / name), tuple(KEY), tuple(VALUES), DDL, buckets=3)


def test_merging_scan_by_scan_gives_the_same_history(spark, tmp_path):
    rows, h = observations(1), table(spark, tmp_path)
    at = {s: [r[:4] for r in rows if r[4] == s] for s in SCANS}
    for i, s in enumerate(SCANS):
        told = h.merge_scan(spark.createDataFrame(at[s], DDL), s)
        before, now = (set(map(repr, at[SCANS[i - 1]])) if i else set()), set(map(repr, at[s]))
        assert (told["opened"], told["closed"]) == (len(now - before), len(before - now))  # as much as changed
        assert h.merge_scan(spark.createDataFrame([], DDL), s) == {"opened": 0, "closed": 0, "buckets": 0}  # again: nothing
    assert listed(h.read(), COLUMNS) == sorted(brute(rows), key=repr)
    with pytest.raises(ValueError):
        h.merge_scan(spark.createDataFrame([], DDL), SCANS[0])


def test_nothing_is_written_when_nothing_changes(spark, tmp_path):
    h, rows = table(spark, tmp_path), spark.createDataFrame([(i, "x", "INT", 1) for i in range(50)], DDL)
    h.merge_scan(rows, "1")
    folders = h.state()["open"]
    assert h.merge_scan(rows, "2") == {"opened": 0, "closed": 0, "buckets": 0} and h.state()["open"] == folders
    told = h.merge_scan(rows.where("asset_id <> 7"), "3")
    assert told == {"opened": 0, "closed": 1, "buckets": 1}
    assert sum(a != b for a, b in zip(sorted(folders.items()), sorted(h.state()["open"].items()))) == 1


@pytest.mark.parametrize("step", ["closed", "open", "commit"])
def test_a_scan_that_fails_half_way_changes_nothing(spark, tmp_path, monkeypatch, step):
    """The writer dies before its commit; the table is as before, and running the scan again gives the whole history."""
    h = table(spark, tmp_path, step)
    one = spark.createDataFrame([(1, "x", "INT", 1), (2, "x", "INT", 1)], DDL)
    two = spark.createDataFrame([(1, "x", "BIGINT", 1), (3, "y", None, None)], DDL)
    h.merge_scan(one, "1")
    before = listed(h.read(), COLUMNS)
    with monkeypatch.context() as m:
        if step == "commit":
            m.setattr(V.HistoryTable, "_commit", lambda self, state: (_ for _ in ()).throw(RuntimeError("lost")))
        else:
            from pyspark.sql.readwriter import DataFrameWriter
            write = DataFrameWriter.parquet

            def fail(self, path, *a, **k):
                write(self, path, *a, **k)
                if f"/{step}/" in path:
                    raise RuntimeError("lost")
            m.setattr(DataFrameWriter, "parquet", fail)
        with pytest.raises(RuntimeError):
            h.merge_scan(two, "2")
    assert listed(h.read(), COLUMNS) == before
    h.merge_scan(two, "2")
    assert listed(h.read(), COLUMNS) == sorted([(1, "x", "INT", 1, "1", "2"), (2, "x", "INT", 1, "1", "2"), (1, "x", "BIGINT", 1, "2", None), (3, "y", None, None, "2", None)], key=repr)


def test_findings_by_scan(spark, scans):
    rows = [(a, f, ["high", "low"][a % 2], 1, s) for a in range(6) for f in ("r",) for i, s in enumerate(SCANS) if i != 4 and (i + a) % 3]
    history = V.from_scans(spark.createDataFrame(rows, "asset_id bigint, field string, severity string, size int, scan string"), scans, KEY, ["severity"])
    got = {r.scan: (r.high, r.low) for r in V.risk_by_scan(history, scans, ["high", "low"]).collect()}
    assert got == {s: tuple(sum(r[4] == s and r[2] == lv for r in rows) for lv in ("high", "low")) for s in SCANS}


def test_no_scans_and_no_rows(spark, scans):
    none = spark.createDataFrame([], f"{DDL}, scan string")
    assert V.from_scans(none, scans, KEY, VALUES).count() == 0
    assert V.changes(V.from_scans(none, scans.limit(0), KEY, VALUES), KEY, VALUES).count() == 0
