"""Detail operators on hand-written rows: blanks, fallbacks, repeats, and tables that aren't there."""

from custos.operators import detail as D
from tests.helpers import catalog, urn


def world(spark):
    assets = [dict(asset_id=1, urn=urn(1), deprecated=True), dict(asset_id=2, urn=urn(2), deprecated=False), dict(asset_id=3, urn=" "), dict(asset_id=4, urn=urn(4))]
    cat = catalog(spark, assets, ownership=[(1, 2, "urn:li:corpuser:b", "T"), (1, 1, "urn:li:corpuser:a", "B"), (1, 3, "urn:li:corpuser:a", "T"), (2, 1, " ", "T")],
                  tags=[(1, "used"), (2, "used"), (2, "other")], fields=[(1, 1, "id", "INT"), (1, 2, "x", None), (2, 1, " ", "INT")],
                  domains=[("urn:li:domain:d", "D"), (None, "nameless")])
    ddl = "asset_id bigint, pos int"
    return cat.with_tables(
        glossary_terms=spark.createDataFrame([(1, 1, " urn:li:glossaryTerm:t ", " ", " "), (1, 2, None, "no urn", None), (3, 1, "urn:li:glossaryTerm:t", "T", None)], f"{ddl}, term_urn string, name string, description string"),
        links=spark.createDataFrame([(1, 1, " http://a ", " d "), (1, 2, "  ", "blank"), (2, 1, None, None)], f"{ddl}, url string, description string"),
        custom_properties=spark.createDataFrame([(1, 1, "k", "old"), (1, 2, " k ", None), (1, 3, "  ", "blank"), (1, 4, "z", " v ")], f"{ddl}, key string, value string"),
        primary_keys=spark.createDataFrame([(1, 1, "x"), (1, 2, "id"), (1, 3, "gone")], f"{ddl}, field_path string"),
        tags=spark.createDataFrame([("urn:li:tag:unused", None, " ", "#fff"), ("urn:li:tag:used", "Used", "text", None), (None, "x", "y", "z")], "tag_urn string, name string, description string, color_hex string"),
        domain_owners=spark.createDataFrame([("urn:li:domain:d", 2, "urn:li:corpuser:a", "T"), ("urn:li:domain:d", 1, "urn:li:corpuser:a", "B"), ("urn:li:domain:d", 3, None, "T")], "domain_urn string, pos bigint, owner_urn string, ownership_type string"))


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_children_of_assets(spark):
    cat = world(spark)
    assert rows(D.asset_terms(cat), "asset_id", "pos", "term_urn", "term", "description") == [(1, 1, "urn:li:glossaryTerm:t", "t", None)]
    assert rows(D.asset_links(cat), "asset_id", "pos", "url", "description") == [(1, 1, "http://a", "d")]
    assert rows(D.asset_properties(cat), "asset_id", "key", "value") == [(1, "k", ""), (1, "z", " v ")]
    assert rows(D.schema_detail(cat), "asset_id", "field_path", "key_pos", "label", "nullable", "is_part_of_key") == [
        (1, "id", 2, None, None, False), (1, "x", 1, None, None, False)]
    assert rows(D.deprecations(cat), "asset_id", "deprecated", "note", "decommission_time") == [(1, True, None, None), (2, False, None, None)]
    assert rows(D.dataset_owners(cat, spark.createDataFrame([(urn(1),), ("urn:none",)], "urn string")), "asset_id", "owner_urn", "pos", "ownership_type") == [
        (1, "urn:li:corpuser:a", 1, "B"), (1, "urn:li:corpuser:b", 2, "T")]


def test_detail_rows_count_what_the_child_tables_hold(spark):
    counts = ("n_owners", "n_tags", "n_terms", "n_fields", "n_keys", "n_links", "n_properties")
    got = {r.asset_id: tuple(r[c] for c in counts) for r in D.asset_detail(world(spark)).collect()}
    assert got == {1: (2, 1, 1, 2, 3, 1, 2), 2: (0, 2, 0, 0, 0, 0, 0), 4: (0,) * 7}
    asked = D.asset_detail(world(spark), spark.createDataFrame([(urn(1),), ("urn:none",)], "urn string"))
    assert rows(asked, "requested_urn", "asset_id", "found") == sorted([(urn(1), 1, True), ("urn:none", None, False)], key=repr)


def test_vocabularies(spark):
    cat = world(spark)
    assert rows(D.tag_vocabulary(cat), "tag_urn", "name", "description", "color_hex", "asset_count") == [
        ("urn:li:tag:other", "other", None, None, 1), ("urn:li:tag:unused", "unused", None, "#fff", 0), ("urn:li:tag:used", "Used", "text", None, 2)]
    assert rows(D.tag_vocabulary(cat, " USE "), "name") == [("Used",), ("unused",)]
    assert rows(D.domain_detail(cat), "domain_urn", "name", "id", "entity_count", "owner_count") == [("urn:li:domain:d", "D", None, 0, 1)]
    assert D.domain_detail(cat, "urn:li:domain:other").count() == 0
    assert rows(D.domain_owner_list(cat), "owner_urn", "pos", "ownership_type", "display_name") == [("urn:li:corpuser:a", 1, "B", "a")]


def test_a_catalogue_without_the_optional_tables(spark):
    cat = catalog(spark, [dict(asset_id=1, urn=urn(1))], principals=[("urn:li:corpuser:x", "X", None, True)])
    assert [D.asset_terms(cat).count(), D.asset_links(cat).count(), D.asset_properties(cat).count(), D.domain_owner_list(cat).count(), D.tag_vocabulary(cat).count()] == [0] * 5
    assert rows(D.principal_details(cat), "owner_urn", "email", "title") == [("urn:li:corpuser:x", None, None)]
    assert rows(D.asset_detail(cat), "asset_id", "n_terms", "created") == [(1, 0, None)]
