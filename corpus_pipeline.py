"""The corpus pipeline: quality, near-duplicates, decontamination, PII, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept.  ``run`` writes each stage's rows to the shared folder, rereads them and removes
those of the stage before.

Every stage keeps columns that it does not know, whatever their names, and needs
``doc_id`` and ``text`` only.  Null and empty texts: they have no features and go or stay
by the quality score of none; near-duplicates, decontamination and PII leave them alone;
packing gives them one piece, the end mark.  Rows without a doc_id are kept by
near-duplicates and judged by their text elsewhere.  Of rows that share a doc_id
near-duplicates keep one.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, minhash, packing, pii, quality_nbsvm
from palimpsest.llm.common import table
from palimpsest.storage import discard, materialize


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns_of(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, names with dots among them."""
    return [F.col(f"`{c}`") for c in docs.columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more."""
    model = quality_nbsvm.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name("score", docs.columns)
    return quality_nbsvm.score(docs, model, docs.columns, score).filter(F.col(score) >= 0.3).select(*columns_of(docs))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.keep_one(docs, percent=85)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), window=10)


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal values; ``n_chars`` follows, where there is one."""
    number, kinds = (free_name(c, docs.columns) for c in ("n_replaced", "kinds"))
    hidden = pii.pseudonyms(docs, key="corpus-2024", counts=(number, kinds))
    if "n_chars" in docs.columns:
        hidden = hidden.withColumn("n_chars", F.when(F.col(number) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return hidden.select(*columns_of(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' ids in sequences of 2048."""
    return packing.pack(docs, capacity=2048)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_distinct),
    ("decontamination", keep_uncontaminated),
    ("pii", hide_personal),
    ("packing", pack_sequences),
]

#: SQL has neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
