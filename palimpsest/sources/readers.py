"""Sources: landed JSON, XML, text and HTML of record feeds, as record tables.

Acquisition over a network is not part of the library: feeds are landed as files
(one page or document each) and read by Spark's own readers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

#: The display fields that every source is normalised to.
RECORD_FIELDS = ("source", "source_trial_id", "title", "scientific_title", "status", "study_type", "phase", "enrollment", "registration_date", "start_date", "completion_date", "conditions", "interventions", "countries", "sponsors", "raw_payload")


def read_landed_json(spark: SparkSession, path: str, records: str | None = None) -> DataFrame:
    """One row per landed document (``raw_payload``), or per element of its array at ``records``."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("raw_payload"))
    if records is None:
        return whole
    items = F.from_json(F.get_json_object("raw_payload", f"$.{records}"), "array<string>")
    return whole.select(F.explode(items).alias("raw_payload"))


def since_day(df: DataFrame, column: str, day: str) -> DataFrame:
    """Rows of the cursor's day or later; the day itself is read again, as late data arrives on it."""
    return df.filter(F.to_date(column) >= F.lit(day).cast("date"))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true")
    return (reader.schema(schema) if schema else reader).load(path)


def aliased(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of several spellings of a tag that the table has and that is not blank."""
    found = [F.when(F.trim(F.col(n).cast("string")) != "", F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def read_text_blocks(spark: SparkSession, path: str, first_label: str) -> DataFrame:
    """``(block, fields)``: records of a plain-text listing that start with a label; ``label: value`` lines as a map.

    A label that comes again keeps its first value.
    """
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", rf"(?m)^(?={first_label}\s*:)")).alias("block")).filter(F.col("block").rlike(rf"^{first_label}\s*:"))
    pairs = F.filter(F.transform(F.split("block", r"\r?\n"), lambda l: F.struct(F.trim(F.regexp_extract(l, r"^([^:]+):", 1)).alias("k"), F.trim(F.regexp_extract(l, r"^[^:]+:(.*)$", 1)).alias("v"))), lambda p: p["k"] != "")
    firsts = F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), lambda acc, p: F.when(F.exists(acc, lambda q: q["k"] == p["k"]), acc).otherwise(F.concat(acc, F.array(p))))
    return blocks.select("block", F.map_from_entries(firsts).alias("fields"))


class _Tables(HTMLParser):
    """Cells of all tables, row by row; label/value pairs of two-cell rows."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.cell = []
        elif tag == "br" and self.cell is not None:
            self.cell.append("\n")

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(" ".join("".join(self.cell).split(" ")).strip())
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def table_rows(html: str | None) -> list[list[str]]:
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    return [r for r in parser.rows if any(r)]


def label_values(html: str | None) -> dict[str, str]:
    """Label -> value of ``label | value | label | value`` rows; of a repeated label the longest value."""
    out: dict[str, str] = {}
    for row in table_rows(html):
        for label, value in zip(row[0::2], row[1::2]):
            label = label.rstrip(":： ").strip()
            if label and len(value) > len(out.get(label, "")):
                out[label] = value
    return out


def parse_grid(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``(key, row, cells)``: a row per table row of a page (Arrow batches; the parser has no native form)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, cells = [], [], []
            for k, h in zip(batch.column(key).to_pylist(), batch.column(html).to_pylist()):
                for i, row in enumerate(table_rows(h)):
                    keys.append(k), rows.append(i), cells.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(key).type), pa.array(rows, pa.int64()), pa.array(cells, pa.list_(pa.string()))], names=[key, "row", "cells"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, row long, cells array<string>")


def parse_details(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``(key, fields)``: the label/value map of a detail page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [list(label_values(h).items()) for h in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(maps, pa.map_(pa.string(), pa.string()))], names=[key, "fields"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, fields map<string,string>")


def site_total(html: Column) -> Column:
    """The number of records that a listing claims to have."""
    return F.regexp_replace(F.regexp_extract(html, r"(?i)(\d[\d,]*)\s*(?:records|trials|条)", 1), ",", "").try_cast("long")


def normalise(df: DataFrame, source: str, mapping: dict[str, Column]) -> DataFrame:
    """The record schema out of a source's columns; missing fields are null."""
    return df.select(F.lit(source).alias("source"), *[mapping.get(f, F.lit(None)).cast("string" if f != "enrollment" else "long").alias(f) for f in RECORD_FIELDS[1:]])


def normalise_json_study(df: DataFrame, payload: str = "raw_payload") -> DataFrame:
    """Records of landed JSON studies, by path; lists stay JSON array text."""
    at = lambda p: F.get_json_object(payload, "$." + p)
    return normalise(
        df,
        "NCT",
        {
            "source_trial_id": at("protocolSection.identificationModule.nctId"),
            "title": at("protocolSection.identificationModule.briefTitle"),
            "scientific_title": at("protocolSection.identificationModule.officialTitle"),
            "status": F.initcap(F.replace(at("protocolSection.statusModule.overallStatus"), F.lit("_"), F.lit(" "))),
            "study_type": F.initcap(at("protocolSection.designModule.studyType")),
            "phase": F.array_join(F.transform(F.from_json(at("protocolSection.designModule.phases"), "array<string>"), lambda p: F.regexp_replace(p, "^(EARLY_)?PHASE", "Phase ")), "/"),
            "enrollment": at("protocolSection.designModule.enrollmentInfo.count").try_cast("long"),
            "start_date": tx.iso_date(at("protocolSection.statusModule.startDateStruct.date"), pad_partial=True),
            "completion_date": tx.iso_date(at("protocolSection.statusModule.completionDateStruct.date"), pad_partial=True),
            "conditions": at("protocolSection.conditionsModule.conditions"),
            "sponsors": at("protocolSection.sponsorCollaboratorsModule.leadSponsor.name"),
            "raw_payload": F.col(payload),
        },
    )


def normalise_aggregator(df: DataFrame) -> DataFrame:
    """Records of an aggregator's XML rows, whatever the spelling of a tag."""
    a = lambda *names: aliased(df, names)
    return normalise(
        df,
        "ICTRP",
        {
            "source_trial_id": a("trial_id", "TrialID", "main_id"),
            "title": a("public_title", "Public_title"),
            "scientific_title": a("scientific_title", "Scientific_title"),
            "status": a("recruitment_status", "Recruitment_Status"),
            "study_type": a("study_type", "Study_type"),
            "phase": a("phase", "Phase"),
            "enrollment": tx.first_integer(a("target_size", "Target_size")),
            "registration_date": tx.iso_date(a("date_registration", "Date_registration")),
            "conditions": tx.to_json_array(F.replace(a("hc_freetext", "Condition"), F.lit(";"), F.lit("\n"))),
            "interventions": tx.to_json_array(F.replace(a("i_freetext", "Intervention"), F.lit(";"), F.lit("\n"))),
            "countries": tx.to_json_array(F.replace(a("country2", "Countries"), F.lit(";"), F.lit("\n"))),
            "sponsors": a("primary_sponsor", "Primary_sponsor"),
        },
    )


def light_record(df: DataFrame) -> DataFrame:
    """The display shape: lists as arrays, phase and status bucketed."""
    return df.withColumns(
        {
            **{c: tx.list_items(F.col(c)) for c in ("conditions", "interventions", "countries", "sponsors")},
            "phase_bucket": tx.phase_bucket(F.col("phase")),
            "status_bucket": tx.status_bucket(F.coalesce("status", F.lit(""))),
        }
    ).drop("raw_payload")


def without_downgrades(new: DataFrame, existing: DataFrame, key: str, thin: Column) -> DataFrame:
    """New rows without thin ones of keys that a full row is known of."""
    full = existing.select(key).distinct().withColumn("__full", F.lit(True))
    return new.join(full, key, "left").filter(~(thin & F.coalesce("__full", F.lit(False)))).drop("__full")
