import json

from pyspark.sql import functions as F

from custos.operators import assets as A
from custos.operators import profile as P
from custos.operators import rules as R
from custos.sources import raw as W

COMPLETE = {
    "urn": "urn:li:dataset:(urn:li:dataPlatform:snowflake,finance.fct_payments,PROD)",
    "type": "DATASET", "name": "fct_payments",
    "platform": {"urn": "urn:li:dataPlatform:snowflake", "name": "snowflake", "properties": {"displayName": "Snowflake"}},
    "subTypes": {"typeNames": ["Table"]},
    "properties": {"name": "  fct_payments ", "qualifiedName": "finance.fct_payments", "description": "Ingested",
                   "lastModified": {"time": 1735689600000}, "created": "1735689600000",
                   "customProperties": [{"key": "team", "value": "a"}, {"key": " team ", "value": "b"},
                                        {"key": "  ", "value": "x"}]},
    "editableProperties": {"description": "Edited by a steward"},
    "ownership": {"owners": [
        {"type": "DATAOWNER", "ownershipType": {"info": {"name": "Technical Owner"}},
         "owner": {"__typename": "CorpUser", "urn": "urn:li:corpuser:jdoe", "username": "jdoe",
                   "properties": {"displayName": "Jane Doe", "email": "j@x", "active": True},
                   "editableProperties": {"displayName": "Jane D."}}},
        {"type": "DATAOWNER", "owner": {"__typename": "CorpUser", "urn": "urn:li:corpuser:jdoe"}},
        {"type": "DATAOWNER", "owner": {"__typename": "CorpGroup", "urn": "urn:li:corpGroup:fin", "name": "finance"}},
        {"type": "DATAOWNER", "owner": {"urn": "  "}}]},
    "domain": {"domain": {"urn": "urn:li:domain:finance", "id": "finance", "properties": {"name": "Finance"}}},
    "tags": {"tags": [{"tag": {"urn": "urn:li:tag:PII", "properties": {"name": "PII"}}},
                      {"tag": {"urn": "urn:li:tag:tier-1"}}]},
    "deprecation": {"deprecated": False},
    "lastIngested": 1735689600000,
    "schemaMetadata": {"name": "x", "primaryKeys": ["id"], "fields": [
        {"fieldPath": "id", "nativeDataType": "BIGINT", "isPartOfKey": True},
        {"fieldPath": "customer_email", "nativeDataType": "VARCHAR", "nullable": True},
        {"fieldPath": " "}]},
    "institutionalMemory": {"elements": [{"url": "https://wiki/x", "description": "Runbook"}, {"url": ""}]},
}
BARE = {"urn": "urn:li:dataset:(urn:li:dataPlatform:postgres,public.bare,PROD)", "name": "bare",
        "platform": None, "properties": {"description": "   ", "lastModified": {"time": 0}},
        "ownership": None, "tags": None, "deprecation": None, "schemaMetadata": None}
NO_URN = {"name": "orphan"}


def raw_df(spark, docs):
    lines = spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string")
    return W.parse_raw(lines)


def test_complete_and_bare_documents(spark):
    raw = raw_df(spark, [COMPLETE, BARE, NO_URN])
    counts = W.raw_counts(raw).first()
    assert (counts.source_total, counts.kept) == (3, 2)
    cat = W.catalog_from_raw(raw)
    a = {r.urn: r for r in A.clean_assets(cat).collect()}
    full, bare = a[COMPLETE["urn"]], a[BARE["urn"]]
    assert full.name == "fct_payments" and full.description == "Edited by a steward"
    assert full.platform == "snowflake" and full.domain_urn == "urn:li:domain:finance"
    assert bare.description is None and bare.last_modified is None and bare.deprecated is False
    owners = A.asset_owners(cat).where(F.col("urn") == COMPLETE["urn"]).orderBy("pos").collect()
    assert [(o.owner_urn, o.ownership_type) for o in owners] == [
        ("urn:li:corpuser:jdoe", "Technical Owner"), ("urn:li:corpGroup:fin", "DATAOWNER")]
    assert owners[0].display_name == "Jane D." and owners[1].kind == "GROUP"
    fields = A.schema_clean(cat).collect()
    assert sorted(f.field_path for f in fields) == ["customer_email", "id"]
    # PII tag present -> no untagged_pii; bare: unowned + undocumented
    rules = {(r.asset_urn, r.rule) for r in R.findings(cat).collect()}
    assert (COMPLETE["urn"], "untagged_pii") not in rules
    assert {(BARE["urn"], "missing_owner"), (BARE["urn"], "missing_documentation")} <= rules


def test_links_terms_and_custom_properties(spark):
    raw = raw_df(spark, [COMPLETE, BARE])
    links = W.documentation_links(raw).collect()
    assert [(l.url, l.description) for l in links] == [("https://wiki/x", "Runbook")]
    props = {r.urn: r.custom_properties for r in W.custom_properties(raw).collect()}
    assert props[COMPLETE["urn"]] == {"team": "b"}
    assert props[BARE["urn"]] == {}


def test_profile_documents_flatten(spark):
    docs = [{"urn": "u1", "timestampMillis": 1735689600000, "rowCount": "10", "columnCount": 2,
             "fieldProfiles": [{"fieldPath": "a", "uniqueCount": 3, "nullProportion": 0.5, "min": "1"},
                               {"fieldPath": ""}]},
            {"urn": "u2", "timestampMillis": 0, "rowCount": True}]
    lines = spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string")
    rows = P.profile_fields(W.parse_raw(lines, schema=W.RAW_PROFILE)).collect()
    by = {(r.urn, r.field_path): r for r in rows}
    assert by[("u1", "a")].unique_count == 3 and by[("u1", "a")].row_count == 10
    assert by[("u1", "a")].profiled_at == "2025-01-01T00:00:00"
    assert by[("u2", None)].row_count is None and by[("u2", None)].profiled_at is None
