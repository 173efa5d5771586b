"""Profiles merged from files: exact figures equal a scan, sketches keep their bounds, a new file alone is read."""

import random
import statistics

import pytest

from custos.operators import sketch_profile as K

DDL = "id bigint, x double, word string, flag boolean, none int"


def data(n, seed):
    rng = random.Random(seed)
    return [(2**54 + rng.randrange(10 * n), None if i % 7 == 0 else rng.gauss(1e6, 3), rng.choice(["a", "bb", "ccc", None]) if i % 3 else f"w{rng.randrange(n)}",
             i % 2 == 0, None) for i in range(n)]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("parts")
    rows = [data(n, i) for i, n in enumerate((4000, 1, 2500))]
    for i, r in enumerate(rows):
        spark.createDataFrame(r, DDL).coalesce(1).write.parquet(str(root / f"p{i}"))
    return [next(str(f) for f in (root / f"p{i}").iterdir() if f.suffix == ".parquet") for i in range(3)], [x for r in rows for x in r]


def test_merged_profile_of_three_files(spark, tmp_path, parts):
    files, rows = parts
    table = K.ProfileTable(spark, str(tmp_path / "t"))
    assert table.update("t", files[:2]) == files[:2]
    assert table.update("t", files) == files[2:] and table.update("t", files) == []  # each file once
    got = {r.column_name: r for r in table.profile("t").collect()}
    assert set(got) == {"id", "x", "word", "flag", "none"}
    for i, name in enumerate(("id", "x", "word", "flag", "none")):
        values = [r[i] for r in rows if r[i] is not None]
        assert (got[name].row_count, got[name].null_count) == (len(rows), len(rows) - len(values))
        assert got[name].distinct_count == pytest.approx(len(set(values)), rel=0.04)
        if name in ("id", "x"):
            assert got[name].min == float(min(values)) and got[name].max == float(max(values))
            assert got[name].mean == pytest.approx(statistics.fmean(values), rel=1e-12)
            assert got[name].stdev == pytest.approx(statistics.stdev(float(v) - float(min(values)) for v in values), rel=1e-2 if name == "id" else 1e-6)
            for q, at in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
                rank = sum(float(v) <= got[name][q] for v in values) / len(values)
                assert abs(rank - at) < 0.03
    assert got["word"].min == 1 and got["none"].median is None and got["none"].mean is None
    common = {f.item: f["count"] for f in got["word"].frequent}
    words = [r[2] for r in rows]
    for w in ("a", "bb", "ccc"):
        assert common[w] == pytest.approx(words.count(w), rel=0.05)


def test_keys_beyond_double_precision_keep_their_order(spark, tmp_path, parts):
    files, rows = parts
    profiles = K.profile_files(spark.read.parquet(*files), "t").where("column_name = 'id'")
    from pyspark.sql import functions as F
    middle = profiles.agg(F.kll_sketch_get_quantile_bigint(F.kll_merge_agg_bigint("ints"), F.lit(0.5))).first()[0]
    assert middle in {r[0] for r in rows}  # a value of the column, not a rounded one


def test_failure_before_the_commit_leaves_no_profile(spark, tmp_path, parts, monkeypatch):
    table = K.ProfileTable(spark, str(tmp_path / "t"))
    with monkeypatch.context() as m:
        m.setattr(table.log, "commit", lambda state: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.update("t", parts[0][:1])
    assert table.rows() is None and table.update("t", parts[0][:1]) == parts[0][:1]
    assert {r.row_count for r in table.profile().collect()} == {4000}


def test_empty_file(spark, tmp_path):
    path = str(tmp_path / "e")
    spark.createDataFrame([], DDL).write.parquet(path)
    assert K.merge(K.profile_files(spark.read.parquet(path), "e")).count() == 0


def test_a_value_is_converted_once_for_all_aggregates(spark, parts):
    plan = K.profile_files(spark.read.parquet(*parts[0]), "t")._jdf.queryExecution().optimizedPlan().toString()
    aggregate = next(line for line in plan.splitlines() if "hll_sketch_agg" in line and "Aggregate" in line)
    assert "as string" not in aggregate and "length(" not in aggregate and "to_json" not in aggregate
