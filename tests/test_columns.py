import datetime as dt

from pyspark.sql import functions as F

from custos.functions import columns as C


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("r")).first()["r"]


def test_clean_text_strips_unicode_whitespace_and_blanks(spark):
    assert one(spark, C.clean_text, None) is None
    assert one(spark, C.clean_text, "") is None
    assert one(spark, C.clean_text, "   ") is None
    assert one(spark, C.clean_text, "\t hello \n") == "hello"
    assert one(spark, C.clean_text, " x ") == "x"
    assert one(spark, C.clean_text, "a b") == "a b"


def test_lenient_int(spark):
    assert one(spark, C.to_int, "42") == 42
    assert one(spark, C.to_int, " 12 ") == 12
    assert one(spark, C.to_int, "12.5") is None
    assert one(spark, C.to_int, "junk") is None
    assert one(spark, C.to_int, "true") is None
    assert one(spark, C.to_int, 42, "bigint") == 42


def test_lenient_float(spark):
    assert one(spark, C.to_float, "1.5") == 1.5
    assert one(spark, C.to_float, "junk") is None
    assert one(spark, C.to_float, "false") is None


def test_epoch_millis(spark):
    assert one(spark, C.ts_from_millis, None, "bigint") is None
    assert one(spark, C.ts_from_millis, 0, "bigint") is None
    assert one(spark, C.ts_from_millis, -1, "bigint") is None
    assert one(spark, C.ts_from_millis, 1735689600000, "bigint") == dt.datetime(2025, 1, 1)
    assert one(spark, C.ts_from_millis, 10 ** 17, "bigint") is None


def test_urn_helpers(spark):
    u = "urn:li:dataset:(urn:li:dataPlatform:snowflake,finance.fct_x,PROD)"
    assert one(spark, C.short_name, u) == "fct_x"
    assert one(spark, C.platform_from_urn, u) == "snowflake"
    assert one(spark, C.urn_name_fallback, u) == "finance.fct_x"
    assert one(spark, C.urn_name_fallback, "urn:li:dataset:plain") == "unknown"
    assert one(spark, C.urn_name_fallback, "urn:li:dataset:(p,a,b,c,PROD)") == "c"


def test_percent_rounds_half_up_and_null_on_empty(spark):
    df = spark.createDataFrame([(1, 8), (0, 0), (1, 3), (2, 3)], "c long, t long")
    out = [r[0] for r in df.select(C.pct("c", "t")).collect()]
    assert out == [13, None, 33, 67]


def test_iso_is_zone_free_in_a_daylight_saving_gap(spark):
    prev = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        ms = 1704067200000 + 1658 * 3600000  # 2024-03-10 02:00 wall clock
        assert one(spark, lambda c: C.iso(C.ts_from_millis(c)), ms, "bigint") == "2024-03-10T02:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)
