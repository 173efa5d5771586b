"""Column-expression helpers shared by the jobs (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from custos.functions import fixed

# Python's str.strip() removes Unicode whitespace plus the ASCII separators
# \x1c-\x1f; Spark's trim() removes only spaces, so strip with a regex.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"



def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """Strip surrounding whitespace; blank or non-string -> null."""
    return F.nullif(F.regexp_replace(col_(c).cast("string"), _EDGE_SPACE, ""), F.lit(""))


def to_int(c) -> Column:
    """Lenient integer over text: surrounding space ignored, optional sign and
    digits only; bool text, decimals and junk -> null (string semantics)."""
    text = F.regexp_replace(col_(c).cast("string"), _EDGE_SPACE, "")
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def to_float(c) -> Column:
    """Lenient double over text; bool text and junk -> null."""
    text = F.regexp_replace(col_(c).cast("string"), _EDGE_SPACE, "")
    return F.when(~F.lower(text).isin("true", "false"), text.try_cast("double"))


def ts_from_millis(ms) -> Column:
    """Epoch milliseconds -> timestamp_ntz (UTC wall clock); 0, negative, junk,
    out of range -> null."""
    ms = to_int(ms)
    return F.when((ms > 0) & (ms < F.lit(253402300800000)),
                  F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))


def iso(c) -> Column:
    """ISO-8601 text (to the second) of a timestamp_ntz, JSON-safe.

    Built from the string cast, which is zone-free for timestamp_ntz;
    ``date_format`` would route the value through the session time zone and
    move wall-clock times that fall in a daylight-saving gap."""
    return F.regexp_replace(F.substring(col_(c).cast("string"), 1, 19), " ", "T")


def wall_clock(c) -> Column:
    """'yyyy-MM-dd HH:mm:ss' text of a timestamp_ntz, zone-free (see ``iso``)."""
    return F.substring(col_(c).cast("string"), 1, 19)


def pct(covered, total) -> Column:
    """Whole percent of covered/total rounded half-up; null when total is 0."""
    covered, total = col_(covered), col_(total)
    return F.when(total > 0, F.floor((covered * 200 + total) / (total * 2)).cast("bigint"))


def risk_level(score) -> Column:
    score = col_(score)
    expr = None
    for minimum, level in fixed.RISK_BANDS:
        expr = (F.when(score >= minimum, level) if expr is None
                else expr.when(score >= minimum, level))
    return expr.otherwise("low")


def health_severity(health) -> Column:
    health = col_(health)
    expr = None
    for upper, level in fixed.HEALTH_BANDS:
        expr = (F.when(health < upper, level) if expr is None
                else expr.when(health < upper, level))
    return expr.otherwise("low")


def severity_rank(sev) -> Column:
    sev = col_(sev)
    return (F.when(sev == "critical", 0).when(sev == "high", 1)
            .when(sev == "medium", 2).otherwise(3))


def urn_name_fallback(urn) -> Column:
    """Second-to-last comma token of the URN, else 'unknown'."""
    parts = F.split(F.coalesce(col_(urn), F.lit("")), ",")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(F.lit("unknown"))


def platform_from_urn(urn) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(col_(urn), r"dataPlatform:([a-zA-Z0-9_-]+)", 1),
                               F.lit("")), F.lit("unknown"))


def short_name(urn) -> Column:
    """`urn:li:dataset:(urn:li:dataPlatform:p,db.schema.tbl,PROD)` -> `tbl`."""
    urn = col_(urn)
    inner = F.regexp_extract(urn, r"\(([^)]*)\)", 1)
    path = F.when(F.instr(urn, "(") > 0,
                  F.coalesce(F.get(F.split(inner, ","), 1), urn)).otherwise(urn)
    return F.substring_index(path, ".", -1)


def asset_kind(entity_type, platform) -> Column:
    et = F.upper(F.coalesce(col_(entity_type), F.lit("DATASET")))
    plat = F.lower(col_(platform))
    return (F.when(et.isin("DASHBOARD", "CHART"), "dashboard")
            .when(et.isin("MLMODEL", "MLFEATURETABLE"), "model")
            .when(et.isin("DATAFLOW", "DATAJOB"), "pipeline")
            .when(plat.isin(*fixed.PIPELINE_PLATFORMS), "pipeline")
            .when(plat.isin(*fixed.DASHBOARD_PLATFORMS), "dashboard")
            .otherwise("dataset"))


def owner_kind(urn) -> Column:
    urn = col_(urn)
    return (F.when(urn.startswith("urn:li:corpuser:"), "USER")
            .when(urn.startswith("urn:li:corpGroup:"), "GROUP").otherwise("UNKNOWN"))


def looks_like_pii(field_path) -> Column:
    return F.coalesce(col_(field_path).rlike(fixed.PII_PATTERN), F.lit(False))


def is_pii_tag(tag) -> Column:
    return F.coalesce(F.lower(col_(tag)).rlike("|".join(fixed.PII_TAG_HINTS)), F.lit(False))


JSON_OPTIONS = {"ignoreNullFields": "false",
                "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss",
                "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}


def json_of(*cols) -> Column:
    """JSON object text of the given columns; nulls kept, timestamps ISO-8601."""
    return F.to_json(F.struct(*cols), JSON_OPTIONS)


def template(text: str, **values) -> Column:
    """Render a fixed sentence: each ``{name}`` becomes the given Column (or
    value) cast to text, everything else stays literal; one ``concat``."""
    import re

    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", text)):
        if i % 2 == 0:
            if piece:
                parts.append(F.lit(piece))
        else:
            v = values[piece]
            parts.append((v if isinstance(v, Column) else F.lit(v)).cast("string"))
    return F.concat(*parts) if parts else F.lit("")
