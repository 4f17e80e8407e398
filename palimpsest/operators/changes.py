"""Field changes between adjacent versions: comparison, unpivoting, event hashes."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from .versions import first_seen

#: Tracked fields whose lists are unordered, and those compared as loose text.
ORDER_INSENSITIVE = ("conditions", "interventions", "countries", "locations", "sponsors")
SEMANTIC_TEXT = ("sponsors", "primary_endpoint", "secondary_endpoints", "interventions", "arm_group_interventions", "eligibility_criteria")
#: Category of a tracked field.
FIELD_CATEGORY = {
    "status_id": "status",
    "enrollment": "enrollment",
    "primary_endpoint": "endpoint",
    "secondary_endpoints": "endpoint",
    "study_phase": "design",
    "study_design": "design",
    "eligibility_criteria": "design",
    "sponsors": "sponsor",
    "locations": "location",
    "countries": "location",
    "start_date": "date",
    "completion_date": "date",
    "primary_completion_date": "date",
    "registration_date": "date",
    "last_updated_at_source": "date",
    "arm_group_interventions": "design",
    "interventions": "design",
    "conditions": "other",
}


def field_category(field: Column, categories: dict[str, str] = FIELD_CATEGORY) -> Column:
    pairs = [F.lit(x) for kv in categories.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), field), F.lit("other"))


def semantic_text(value: Column) -> Column:
    """White space collapsed, end punctuation and case dropped."""
    one = F.trim(F.regexp_replace(value, r"(?U)\s+", " "))
    return F.lower(F.regexp_replace(one, r"(?U)[\s.,;:]+$", ""))


def canonical_json(value: Column) -> Column:
    """Compact JSON with sorted keys; null where the text is no JSON."""
    return F.to_json(F.try_parse_json(value))


_LOOKS_LIKE_JSON = r"^[\[{\"]"


def values_differ(old: Column, new: Column) -> Column:
    """Whether two texts differ: null and empty are equal; lists, objects and quoted strings compare by canonical form."""
    a, b = F.trim(F.coalesce(old, F.lit(""))), F.trim(F.coalesce(new, F.lit("")))
    parsed = a.rlike(_LOOKS_LIKE_JSON) & b.rlike(_LOOKS_LIKE_JSON)
    return F.when(a == b, False).when(parsed, F.coalesce(canonical_json(a) != canonical_json(b), F.lit(True))).otherwise(True)


def numbers_differ(old: Column, new: Column) -> Column:
    """Whether two numbers differ: null and 0 are equal."""
    return F.coalesce(old, F.lit(0)) != F.coalesce(new, F.lit(0))


def _canonical(value: str | None, unordered: bool, loose: bool) -> str:
    """Comparable text of a nested value."""

    def walk(x):
        if isinstance(x, str) and loose:
            return " ".join(x.split()).rstrip(" \t\n.,;:").casefold()
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items()}
        if isinstance(x, list):
            items = [walk(v) for v in x]
            return sorted(items, key=lambda v: json.dumps(v, sort_keys=True, ensure_ascii=False)) if unordered else items
        return x

    text = (value or "").strip()
    if not text:
        return ""
    try:
        parsed = json.loads(text)
    except ValueError:
        parsed = text
    if loose and isinstance(parsed, list) and len(parsed) == 1 and not isinstance(parsed[0], (list, dict)):
        parsed = parsed[0]
    if not isinstance(parsed, (list, dict)) and loose:
        return walk(str(parsed))
    return json.dumps(walk(parsed), sort_keys=True, ensure_ascii=False)


@F.pandas_udf(StringType())
def canonical_value(value: pd.Series, field: pd.Series) -> pd.Series:
    """Canonical text of nested JSON by the field's rules; only for rows that differ as text."""
    return pd.Series([_canonical(v, f in ORDER_INSENSITIVE, f in SEMANTIC_TEXT) for v, f in zip(value, field)])


def detect_changes(versions: DataFrame, keys: Sequence[str], order: Sequence[str | Column], fields: Sequence[str], carry: Sequence[str] = (), nested: bool = False) -> DataFrame:
    """``(keys, carry, field_name, old_value, new_value)``: one row per changed field of a version.

    One window per key gives the row before; of its fields only the changed ones become rows.
    Numeric columns compare as numbers, others as text.  ``nested`` also compares JSON lists by
    their field's rules (an Arrow function on rows that differ as text only).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    before = versions.withColumn("__old", F.lag(F.struct(*fields)).over(w)).filter("__old is not null")

    def change(f: str) -> Column:
        old, new = F.col(f"__old.{f}"), F.col(f)
        differ = numbers_differ(old, new) if isinstance(versions.schema[f].dataType, NumericType) else values_differ(old.cast("string"), new.cast("string"))
        return F.when(differ, F.struct(F.lit(f).alias("field_name"), old.cast("string").alias("old_value"), new.cast("string").alias("new_value")))

    out = before.select(*keys, *carry, F.explode(F.array_compact(F.array(*[change(f) for f in fields]))).alias("__c")).select(*keys, *carry, "__c.*")
    if nested:
        out = out.filter(canonical_value("old_value", "field_name") != canonical_value("new_value", "field_name"))
    return out


def downgraded(versions: DataFrame, keys: Sequence[str], order: Sequence[str | Column], stub: Column) -> DataFrame:
    """Drops thin versions that would follow a full one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return versions.withColumn("__full", F.max(F.when(stub, 0).otherwise(1)).over(w)).filter(~(stub & (F.coalesce("__full", F.lit(0)) == 1))).drop("__full")


def event_hash(keys: Sequence[str | Column], field: Column, new: Column) -> Column:
    """SHA-256 of key, field and canonical new value; the old value takes no part."""
    value = F.coalesce(canonical_json(F.trim(new)), F.trim(new), F.lit(""))
    return F.sha2(F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys], field, value), 256)


def first_events(events: DataFrame, order: Sequence[str], hash_col: str = "event_hash") -> DataFrame:
    """Events of a hash seen first; later ones are repetitions."""
    return first_seen(events, [hash_col], order)


def value_deltas(old: Column, new: Column) -> dict[str, Column]:
    """Number, percent and day differences of two values given as text; null where they don't parse."""
    a, b = old.try_cast("double"), new.try_cast("double")
    iso = r"^\d{4}-\d{2}-\d{2}"
    day = lambda c: F.when(c.rlike(iso), F.try_to_date(F.substring(c, 1, 10)))
    return {"delta": b - a, "percent": F.when(a != 0, (b - a) / F.abs(a) * 100), "days": F.datediff(day(new), day(old))}
