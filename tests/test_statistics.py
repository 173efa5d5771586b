from pyspark.sql import functions as F

from custos.operators import usage as S
from custos.sources.catalog import Catalog
from tests.conftest import SF_SMALL


def test_missing_usage_table_keeps_profiles(spark):
    cat = Catalog.from_testdata(spark, SF_SMALL)
    no_usage = cat.with_tables(usage_events=None)
    rows = S.statistics_summary(no_usage).collect()
    assert all(r.usage_available is False and r.total_queries is None for r in rows)
    assert all(r.usage_unavailable_reason for r in rows)
    assert any(r.profiled for r in rows)


def test_summary_distinguishes_absent_from_zero(spark):
    cat = Catalog.from_testdata(spark, SF_SMALL)
    rows = {r.asset_id: r for r in S.statistics_summary(cat).collect()}
    unprofiled = [r for r in rows.values() if not r.profiled]
    assert all(r.row_count is None for r in unprofiled)
    assert all(r.total_queries is not None for r in rows.values())


def test_time_range_narrows_usage(spark):
    cat = Catalog.from_testdata(spark, SF_SMALL)
    day = S.usage_summary(cat, "DAY").agg(F.sum("total_queries")).first()[0]
    month = S.usage_summary(cat, "MONTH").agg(F.sum("total_queries")).first()[0]
    assert 0 < day < month


def test_top_users_are_ranked_by_count(spark):
    cat = Catalog.from_testdata(spark, SF_SMALL)
    top = S.usage_top_users(cat, 3).collect()
    by = {}
    for r in top:
        by.setdefault(r.asset_id, []).append((r.user_rank, r.query_count))
    for ranks in by.values():
        counts = [c for _, c in sorted(ranks)]
        assert counts == sorted(counts, reverse=True) and len(counts) <= 3


def test_data_dictionary_prints_descriptions_and_escapes_pipes(spark):
    from pyspark.sql import functions as F

    from custos.operators import reports as T
    from tests.helpers import catalog, urn
    cat = catalog(spark, [dict(asset_id=1, urn=urn(1), name="t1")], fields=[(1, 1, "a|b", "INT")])
    cat = cat.with_tables(schema_fields=cat.schema_fields.withColumn("field_description", F.lit(" what it | means ")),
                          profiles=spark.createDataFrame([], "asset_id bigint, profiled_at timestamp, row_count bigint, size_in_bytes bigint"))
    lines = [r.line for r in T.data_dictionary(cat).collect()]
    assert any("what it \\| means" in x and "a\\|b" in x for x in lines)
