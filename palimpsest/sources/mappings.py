"""Field mappings of single registries onto the record schema, and their status vocabularies.

Status rules are ordered: the first pattern that occurs in the lower-cased text names the status.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .readers import normalise

#: Words of a registry's status and the status they stand for, in the order they are tried.
CTIS_STATUS = (
    ("recruit", "Recruiting"),
    ("not yet recruiting|recruitment not started", "Not yet recruiting"),
    ("completed|end of trial|ended", "Completed"),
    ("withdraw", "Withdrawn"),
    ("suspend|temporarily halt", "Suspended"),
    ("authori[sz]ed", "Registered"),
    ("evaluation|submitted|pre-author", "Pre-registration"),
)
ISRCTN_STATUS = (("not yet|not started", "Not yet recruiting"), ("recruit", "Recruiting"), ("complete|closed", "Completed"), ("suspend", "Suspended"), ("withdraw", "Withdrawn"))
EUCTR_STATUS = (
    ("premature|terminated", "Terminated"),
    ("suspend|temporarily halt", "Suspended"),
    ("withdraw|not authori[sz]ed", "Withdrawn"),
    ("complete|ended", "Completed"),
    ("ongoing", "Active, not recruiting"),
    ("transition|authori[sz]", "Registered"),
)
#: Numeric CTIS states (others are unknown), and texts that name a finished recruitment.
CTIS_CODES = {"2": "Registered"}
CTIS_OVER = "not recruit|no recruit|ended"


def first_word(text: Column, rules: Sequence[tuple[str, str]], other: Column | None = None) -> Column:
    """The value of the first pattern that the text holds; null for blank texts."""
    low = F.lower(F.trim(text))
    out = other if other is not None else F.lit(None).cast("string")
    for pattern, value in reversed(list(rules)):
        out = F.when(low.rlike(pattern), value).otherwise(out)
    return F.when(low != "", out)


def ctis_status(value: Column) -> Column:
    """A CTIS status of text or code.

    A finished recruitment is no recruiting one; any other text about recruiting is, "not yet" included.
    """
    text = F.trim(value)
    known = F.create_map(*[F.lit(x) for kv in CTIS_CODES.items() for x in kv])
    over = [r for r in CTIS_STATUS if r[0] != "recruit"]
    named = F.when(F.lower(text).rlike(CTIS_OVER), first_word(text, over, text)).otherwise(first_word(text, CTIS_STATUS, text))
    return F.when(text.rlike("^[0-9]+$"), F.element_at(known, text)).otherwise(named)


def _names(payload: Column, path: str, fields: Sequence[str]) -> Column:
    """Array of the first of ``fields`` (dotted names) that each object of a list has."""
    items = F.coalesce(F.from_json(F.get_json_object(payload, path), "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(items, lambda x: F.trim(F.coalesce(*[F.get_json_object(x, f"$.{f}") for f in fields]))), lambda v: F.coalesce(v != "", F.lit(False)))


def _json(*parts: Column) -> Column:
    """JSON array text of the distinct values; null without any."""
    values = F.array_distinct(F.concat(*parts))
    return F.when(F.size(values) > 0, F.to_json(values))


_PART = "$._detail.authorizedApplication.authorizedPartI"


def normalise_ctis(df: DataFrame, payload: str = "raw_payload") -> DataFrame:
    """Records of CTIS payloads that hold a search hit and its detail."""
    p = F.col(payload)
    at = lambda *paths: F.coalesce(*[F.get_json_object(p, f"$.{x}") for x in paths])
    trial = "_detail.authorizedApplication.authorizedPartI.trialDetails"
    info = [f"{trial}.trialInformation", trial]
    listed = lambda path, *fields: F.concat(*[_names(p, f"$.{i}.{path}", fields) for i in info])
    products = F.concat(_names(p, f"{_PART}.products", ["productName"]), _names(p, f"{_PART}.products", ["productDictionaryInfo.activeSubstanceName"]))
    plain = F.coalesce(F.split(at("_search.product"), r"\s*,\s*"), F.array().cast("array<string>"))
    sponsors = _names(p, f"{_PART}.sponsors", ["organisation.name"])
    sponsor = F.filter(F.array(at("_search.sponsor")), lambda x: x.isNotNull())
    return normalise(
        df,
        "CTIS",
        {
            "source_trial_id": at("_detail.ctNumber", "_search.ctNumber", "_search.ctisId"),
            "title": at(f"{trial}.clinicalTrialIdentifiers.publicTitle", "_search.ctTitle", f"{trial}.clinicalTrialIdentifiers.fullTitle"),
            "scientific_title": at(f"{trial}.clinicalTrialIdentifiers.fullTitle"),
            "status": ctis_status(at("_detail.ctStatus", "_search.ctStatus")),
            "study_type": F.lit("Interventional"),
            "phase": at("_search.trialPhase"),
            "enrollment": F.replace(at("_search.totalNumberEnrolled"), F.lit(","), F.lit("")).try_cast("long"),
            "registration_date": tx.iso_date(at("_detail.publishDate", "_detail.decisionDate", "_search.decisionDateOverall")),
            "start_date": tx.iso_date(at(*[f"{i}.trialDuration.estimatedRecruitmentStartDate" for i in info])),
            "completion_date": tx.iso_date(at(*[f"{i}.trialDuration.{f}" for f in ("estimatedEndDate", "globalEndOfTrialDate") for i in info])),
            "conditions": _json(listed("medicalCondition.partIMedicalConditions", "medicalCondition"), listed("medicalCondition.meddraConditionTerms", "termName")),
            "interventions": _json(F.when(F.size(products) > 0, products).otherwise(plain)),
            "countries": _json(_names(p, "$._detail.authorizedApplication.authorizedPartsII", ["mscInfo.countryName"])),
            "sponsors": _json(F.when(F.size(sponsors) > 0, sponsors).otherwise(sponsor)),
            "raw_payload": p,
        },
    )


ISRCTN_SCHEMA = """_publicIdentifierCanonical string, _publicIdentifierDateAssigned string, _lastUpdated string, isrctn string,
trialDescription struct<title:string,scientificTitle:string>, trialDesign struct<primaryStudyDesign:string,overallEndDate:string>,
participants struct<recruitmentStart:string,recruitmentEnd:string,recruitmentStatusOverride:string,recruitmentStartStatusOverride:string,targetEnrolment:string,recruitmentCountries:struct<country:array<string>>>,
conditions struct<condition:array<struct<description:string>>>, interventions struct<intervention:array<struct<drugNames:string,description:string,phase:string>>>"""


def isrctn_status(explicit: Column, start: Column, recruited: Column, ended: Column, as_of: str) -> Column:
    """The status a record states, else the one its dates give at ``as_of``."""
    day = F.lit(as_of).cast("date")
    dated = F.when(start > day, "Not yet recruiting").when(ended < day, "Completed").when(recruited < day, "Active, not recruiting").when(start.isNotNull(), "Recruiting").otherwise("Registered")
    return F.coalesce(first_word(explicit, ISRCTN_STATUS), dated)


def normalise_isrctn(df: DataFrame, as_of: str) -> DataFrame:
    """Records of the ``trial`` elements of ISRCTN XML, read with ``ISRCTN_SCHEMA``."""
    number = F.upper(F.coalesce("_publicIdentifierCanonical", "isrctn"))
    date = lambda c: tx.iso_date(F.col(c))
    empty = F.array().cast("array<string>")
    known = lambda c: F.filter(F.coalesce(c, empty), lambda v: F.coalesce(F.trim(v) != "", F.lit(False)))
    arms = F.col("interventions.intervention")
    override = F.coalesce("participants.recruitmentStatusOverride", "participants.recruitmentStartStatusOverride")
    return normalise(
        df.filter(number.isNotNull()),
        "ISRCTN",
        {
            "source_trial_id": F.when(number.startswith("ISRCTN"), number).otherwise(F.concat(F.lit("ISRCTN"), number)),
            "title": F.col("trialDescription.title"),
            "scientific_title": F.col("trialDescription.scientificTitle"),
            "status": isrctn_status(override, date("participants.recruitmentStart"), date("participants.recruitmentEnd"), date("trialDesign.overallEndDate"), as_of),
            "study_type": F.col("trialDesign.primaryStudyDesign"),
            "phase": F.array_join(F.array_distinct(known(F.transform(arms, lambda x: x["phase"]))), "/"),
            "enrollment": tx.first_integer(F.col("participants.targetEnrolment")),
            "registration_date": date("_publicIdentifierDateAssigned"),
            "start_date": date("participants.recruitmentStart"),
            "completion_date": date("trialDesign.overallEndDate"),
            "conditions": _json(known(F.transform("conditions.condition", lambda x: x["description"]))),
            "interventions": _json(known(F.transform(arms, lambda x: F.coalesce(x["drugNames"], x["description"])))),
            "countries": _json(known(F.col("participants.recruitmentCountries.country"))),
        },
    )


def normalise_euctr(blocks: DataFrame) -> DataFrame:
    """Records of EUCTR summary blocks ``(block, fields)`` as ``read_text_blocks`` gives them."""
    field = lambda name: F.trim(F.try_element_at("fields", F.lit(name)))
    protocols = F.regexp_extract_all(field("Trial protocol"), F.lit(r"([A-Za-z0-9]{2,3}) ?\("), F.lit(1))
    states = F.regexp_extract_all(field("Trial protocol"), F.lit(r"\(([^)]*)\)"), F.lit(1))
    return normalise(
        blocks.filter(field("EudraCT Number").rlike(r"^20[0-9]{2}-[0-9]{6}-[0-9]{2}")),
        "EUCTR",
        {
            "source_trial_id": F.regexp_extract(field("EudraCT Number"), r"^(20[0-9]{2}-[0-9]{6}-[0-9]{2})", 1),
            "title": field("Full Title"),
            "status": first_word(F.try_element_at(states, F.lit(1)), EUCTR_STATUS, F.try_element_at(states, F.lit(1))),
            "study_type": F.lit("Interventional"),
            "start_date": tx.iso_date(field("Start Date")),
            "conditions": F.when(field("Medical condition") != "", F.to_json(F.array(field("Medical condition")))),
            "countries": F.when(F.size(protocols) > 0, F.to_json(F.transform(protocols, lambda c: F.upper(c)))),
            "sponsors": F.when(field("Sponsor Name") != "", F.to_json(F.array(field("Sponsor Name")))),
            "raw_payload": F.col("block"),
        },
    )
