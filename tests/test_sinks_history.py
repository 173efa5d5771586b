import glob
import os

from pyspark.sql import functions as F

from custos.operators import history as H
from custos.operators import reports as T
from custos.operators import rules as R
from custos.sources.catalog import Catalog
from tests.conftest import SF_SMALL


def test_markdown_documents_written_in_order(spark, tmp_dir):
    lines = spark.createDataFrame([("a", 2, "second"), ("a", 1, "first"), ("b", 1, "only")],
                                  "doc string, line_no int, line string")
    T.write_documents(lines, tmp_dir, "doc", ["line_no"])
    text = "".join(open(f).read() for f in sorted(glob.glob(os.path.join(tmp_dir, "doc=a", "*.txt"))))
    assert text == "first\nsecond\n"


def test_a_large_document_is_split_over_tasks(spark, tmp_dir):
    n = 20_000
    lines = spark.range(n, numPartitions=8).select(
        F.lit("big").alias("doc"), (F.col("id") * 7919 % n).alias("line_no")).withColumn("line", F.concat(F.lit("line "), "line_no"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little would be put together again
    try:
        T.write_documents(lines, tmp_dir, "doc", ["line_no"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = sorted(glob.glob(os.path.join(tmp_dir, "doc=big", "*.txt")))
    assert len(files) > 1
    assert "".join(open(f).read() for f in files).splitlines() == [f"line {i}" for i in range(n)]


def test_report_filename_is_safe():
    assert T.report_filename("find_risky_datasets", "2025-01-02T03:04:05.123Z") == \
        "governance-find_risky_datasets-2025-01-02-03-04-05.md"


def test_executive_report_sections(spark):
    cat = Catalog.from_testdata(spark, SF_SMALL)
    f = R.findings(cat)
    from custos.operators import rollups as U
    doc = T.executive_report(R.catalogue_verdict(cat), f, U.recommendations(f), "q?", "find_missing_owners")
    lines = [r.line for r in doc.orderBy("part", "neg_score", "section_asset", "line_in_section").collect()]
    assert lines[0] == "# Governance Assessment"
    assert any(l.startswith("| | | **") and "→ **" in l for l in lines)
    assert any(l.startswith("1. **") for l in lines)


def test_persisted_findings_overwrite_one_date_only(spark, tmp_dir):
    cat = Catalog.from_testdata(spark, SF_SMALL)
    f = R.findings(cat)
    H.persist_findings(f, tmp_dir, "2024-01-01")
    H.persist_findings(f.limit(3), tmp_dir, "2024-01-02")
    H.persist_findings(f.limit(5), tmp_dir, "2024-01-02")
    back = spark.read.parquet(tmp_dir)
    counts = {str(r.scan_date): r["count"] for r in back.groupBy("scan_date").count().collect()}
    assert counts == {"2024-01-01": f.count(), "2024-01-02": 5}


def test_aspect_upsert_is_idempotent(spark, tmp_dir):
    ev = H.aspect_events(Catalog.from_testdata(spark, SF_SMALL))
    H.upsert_aspects(ev, tmp_dir)
    first = sorted(map(tuple, spark.read.parquet(tmp_dir).collect()))
    H.upsert_aspects(ev, tmp_dir)
    assert sorted(map(tuple, spark.read.parquet(tmp_dir).collect())) == first


def test_catalogue_round_trips_through_parquet_tables(spark, tmp_dir):
    cat = Catalog.from_testdata(spark, SF_SMALL)
    cat.write_parquet(tmp_dir)
    back = Catalog.from_parquet(spark, tmp_dir)
    assert set(back.table_names()) == set(cat.table_names())
    a = sorted(map(tuple, R.findings(cat).collect()))
    b = sorted(map(tuple, R.findings(back).collect()))
    assert a == b


def test_every_item_of_a_list_aspect_survives(spark):
    cat = Catalog.from_testdata(spark, SF_SMALL)
    now = H.latest_aspects(H.aspect_events(cat))
    n = {r.aspect: r["count"] for r in now.groupBy("aspect").count().collect()}
    assert n["schemaMetadata"] == cat.schema_fields.count()
    assert n["globalTags"] == cat.asset_tags.distinct().count()
    assert n["ownership"] == cat.ownership.select("asset_id", "owner_urn", "ownership_type").distinct().count()
