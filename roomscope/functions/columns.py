"""Scalar expressions over photo records; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def object_key(uri: Column) -> Column:
    """The key of ``s3://bucket/key``, empty for a bare bucket; any other text as it is."""
    return F.when(uri.startswith("s3://"), F.regexp_extract(uri, r"(?s)^s3://[^/]*/(.*)$", 1)).otherwise(uri)


def effective_label(override: Column, label: Column) -> Column:
    """The first of override and label that isn't null or empty, else 'unknown'."""
    return F.coalesce(F.nullif(override, F.lit("")), F.nullif(label, F.lit("")), F.lit("unknown"))


def json_text(document: Column, key: str) -> Column:
    """The JSON text of a top-level key, strings quoted; null if the key is absent or the document isn't an object."""
    value = F.try_variant_get(F.try_parse_json(document), f"$.{key}", "variant")
    return F.to_json(value)


def truthy(text: Column) -> Column:
    """Whether a JSON value counts as true: not absent, null, false, zero or empty."""
    zero = F.coalesce(text.rlike(r"^-?0+(\.0+)?([eE][+-]?\d+)?$"), F.lit(False))
    return F.coalesce(~text.isin("null", "false", '""', "[]", "{}") & ~zero, F.lit(False))


def whole_number(text: Column) -> Column:
    """A JSON value as a whole number: numbers truncated, booleans 0 and 1, strings of digits; else null."""
    inner = F.regexp_extract(text, r'^"\s*([+-]?\d+)\s*"$', 1)
    return (
        F.when(text == "true", F.lit(1).cast("bigint"))
        .when(text == "false", F.lit(0).cast("bigint"))
        .when(text.startswith('"'), F.nullif(inner, F.lit("")).try_cast("bigint"))
        .otherwise(text.try_cast("double").try_cast("bigint"))
    )


def is_object(document: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(document)).startswith("OBJECT"), F.lit(False))


def base_score(sharpness: Column, exposure: Column, composition: Column) -> Column:
    return F.lit(0.4) * sharpness + F.lit(0.3) * exposure + F.lit(0.3) * composition


#: What each annotation adds to a score.
BONUS = {"hero_global": 0.30, "hero_room": 0.20, "preferred_opening": 0.10, "preferred_closing": 0.10}
PER_PRIORITY, DEFAULT_SCORE = 0.05, 0.5


def final_score(base: Column, document: Column, exclude: Column) -> Column:
    """The base score with the bonuses of the annotations, at most 1; 0 for excluded records; the default where an annotation can't be read.

    A base of 0 or null counts as the default. The priority is read before exclusion is looked at.
    """
    start = F.coalesce(F.nullif(base, F.lit(0.0)), F.lit(DEFAULT_SCORE))
    total = start
    for key, bonus in BONUS.items():
        total = total + F.when(truthy(json_text(document, key)), F.lit(bonus)).otherwise(F.lit(0.0))
    given = json_text(document, "hero_priority")
    number = whole_number(given)
    total = total + F.coalesce(number * F.lit(PER_PRIORITY), F.lit(0.0))
    unreadable = (document.isNotNull() & ~is_object(document)) | (given.isNotNull() & number.isNull())
    out = F.coalesce(exclude, F.lit(False)) | truthy(json_text(document, "exclude"))
    return F.when(unreadable, F.lit(DEFAULT_SCORE)).when(out, F.lit(0.0)).otherwise(F.least(F.lit(1.0), total))


def depth_tier(variance: Column) -> Column:
    """Tier of a cluster's mean depth variance; null and NaN are low."""
    v = F.when(~F.isnan(variance), variance)
    return F.when(v > 0.06, "high").when(v > 0.035, "medium").otherwise("low")


def photo_tier(variance: Column, layers: Column) -> Column:
    """Tier of a single photo's depth."""
    v = F.when(~F.isnan(variance), variance)
    return F.when((v > 0.1) & (layers >= 4), "high").when((v > 0.05) & (layers >= 2), "medium").otherwise("low")
