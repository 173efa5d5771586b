"""Small hand-written catalogues for unit tests."""

from custos.sources.catalog import Catalog

ASSET_COLS = ("asset_id bigint, urn string, platform string, name string, description string, "
              "editable_description string, deprecated boolean, domain_urn string, schema_drift boolean, "
              "last_modified_ms bigint")


def urn(i, name=None, platform="snowflake"):
    return f"urn:li:dataset:(urn:li:dataPlatform:{platform},db.{name or f't{i}'},PROD)"


def catalog(spark, assets, ownership=(), tags=(), fields=(), edges=(), principals=(), domains=()):
    """assets: dicts with asset_id and any of the asset columns."""
    names = [c.split()[0] for c in ASSET_COLS.split(", ")]
    rows = [tuple(a.get(n) for n in names) for a in assets]
    return Catalog(
        assets=spark.createDataFrame(rows, ASSET_COLS),
        domains=spark.createDataFrame(list(domains), "domain_urn string, name string"),
        principals=spark.createDataFrame(list(principals), "owner_urn string, display_name string, editable_display_name string, active boolean"),
        ownership=spark.createDataFrame(list(ownership), "asset_id bigint, pos bigint, owner_urn string, ownership_type string"),
        asset_tags=spark.createDataFrame(list(tags), "asset_id bigint, tag string"),
        schema_fields=spark.createDataFrame(list(fields), "asset_id bigint, pos int, field_path string, native_data_type string"),
        lineage_edges=spark.createDataFrame(list(edges), "src bigint, dst bigint"),
    )
