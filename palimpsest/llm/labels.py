"""A bounded sample of labelled documents, the same at every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold

#: Characters of the longest text that a classifier is fitted on.
LONGEST = 100_000


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, folds: int = 5, longest: int = LONGEST) -> DataFrame:
    """``(doc_id, text, lang, label)`` of at most ``rows`` labelled documents outside the held-out fold.

    Rows with a null id or label are left out; several labels of one id count as the
    lowest, several texts as the smallest, so an id is one row.  The sample takes the ids
    of the smallest hash, and of these the texts of at most ``longest`` characters: what
    a fit collects is bounded by the two parameters.
    """
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), folds) != 0))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang.alias("lang")).filter(F.length("text") <= longest)
    # at most `rows` rows of two numbers: the bound of the broadcast
    found = texts.join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("lang").alias("lang"), F.min("label").alias("label"))
