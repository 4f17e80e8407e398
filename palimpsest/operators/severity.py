"""Severity of a field change, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rank and base score of each severity.
RANK = {"critical": 4, "important": 3, "normal": 2, "minor": 1}
BASE_SCORE = {"critical": 90.0, "important": 60.0, "normal": 30.0, "minor": 10.0}
#: Severity and score added to the base, by field.
FIELD_RULES = {
    "primary_endpoint": ("critical", 5),
    "interventions": ("critical", 4),
    "arm_group_interventions": ("critical", 4),
    "sponsors": ("critical", 3),
    "enrollment": ("important", 3),
    "primary_completion_date": ("important", 2),
    "completion_date": ("important", 1),
    "eligibility_criteria": ("important", 0),
    "countries": ("important", 0),
    "locations": ("important", 0),
    "study_design": ("important", 0),
    "study_phase": ("important", 0),
    "secondary_endpoints": ("normal", 0),
    "conditions": ("normal", 0),
    "start_date": ("normal", 0),
    "registration_date": ("normal", 0),
    "last_updated_at_source": ("minor", 0),
    "contacts": ("minor", 0),
}
#: Severity by category, for fields without a rule.
CATEGORY_RULES = {"status": "important", "endpoint": "normal", "date": "normal", "location": "important", "sponsor": "critical", "enrollment": "important", "design": "important", "other": "normal"}
#: Kinds of fields, the terminal statuses, and the material share of an enrollment change.
DATE_FIELDS = ("start_date", "primary_completion_date", "completion_date", "registration_date")
LIST_FIELDS = ("conditions", "countries", "locations", "sponsors", "interventions", "secondary_endpoints", "arm_group_interventions", "contacts")
TERMINAL_STATUS = "(?i)terminat|withdrawn|suspended|中止|终止|暂停"
MATERIAL_RATIO = 0.20


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for name, rank in RANK.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def _lookup(values: dict, key: Column) -> Column:
    """The value of a constant map; null for other keys."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _result(severity: Column | str, change: Column | str, score: Column | float) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(severity).alias("severity"), as_column(change).alias("change_type"), as_column(score).cast("double").alias("importance_score"))


def _items(value: Column) -> Column:
    parsed = F.from_json(value, "array<string>")
    return F.transform(F.coalesce(parsed, F.array().cast("array<string>")), lambda x: F.trim(x))


def classify_change(field: Column, old: Column, new: Column, category: Column | None = None, new_status: Column | None = None, terminal: str = TERMINAL_STATUS, status_field: str = "status_id", number_field: str = "enrollment") -> Column:
    """Struct ``(severity, change_type, importance_score)`` of one change."""
    category = F.lit("") if category is None else category
    target = F.coalesce(new_status if new_status is not None else F.lit(None), new, F.lit(""))
    status = F.when(target.rlike(terminal), _result("critical", "status_transition", 95.0)).otherwise(_result("important", "status_transition", 60.0))

    a, b = F.trim(old).try_cast("double"), F.trim(new).try_cast("double")
    direction = F.when(b > a, "numeric_increase").otherwise("numeric_decrease")
    material = F.abs(b - a) / F.abs(a) >= MATERIAL_RATIO
    number = (
        F.when(a.isNull() | b.isNull(), _result("important", F.when(F.coalesce(new, F.lit("")) != "", "added").otherwise("removed"), 60.0))
        .when(a == 0, _result("important", "modified", 60.0))
        .when(material, _result("important", direction, 63.0))
        .otherwise(_result("normal", direction, 30.0))
    )

    severity = F.coalesce(_lookup({k: v[0] for k, v in FIELD_RULES.items()}, field), _lookup(CATEGORY_RULES, category), F.lit("normal"))
    score = _lookup(BASE_SCORE, severity) + F.coalesce(_lookup({k: v[1] for k, v in FIELD_RULES.items()}, field), F.lit(0))

    listed = F.when(F.size(F.array_except(_items(new), _items(old))) > 0, "list_item_added").when(F.size(F.array_except(_items(old), _items(new))) > 0, "list_item_removed").otherwise("modified")
    plain = F.when(F.coalesce(old, F.lit("")) == "", "added").when(F.coalesce(new, F.lit("")) == "", "removed").otherwise("modified")
    return (
        F.when(field == status_field, status)
        .when(field == number_field, number)
        .when(field.isin(*DATE_FIELDS), _result(severity, "date_shift", score))
        .when(field.isin(*LIST_FIELDS), _result(severity, listed, score))
        .otherwise(_result(severity, plain, score))
    )
