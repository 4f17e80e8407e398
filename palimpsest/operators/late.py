"""Late versions: maintenance of change events with retractions.

A version that arrives between two known ones replaces one change event by two.  Only keys with fresh
versions are looked at, and of these only the known versions next to a fresh one: the delta retracts
(``op`` -1) events that no longer follow from adjacent versions and asserts (``op`` 1) those that do.
Applied to the stored events it gives what a full recomputation over all versions gives.

A fresh version whose key and order values are known already is a replay and changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import discard, exists, materialize
from .changes import detect_changes

CHANGE = ["field_name", "old_value", "new_value"]


def change_rows(versions: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``(keys, order, field_name, old_value, new_value)`` of adjacent versions."""
    return detect_changes(versions, keys, list(order), fields, carry=list(order))


def unknown(known: DataFrame, fresh: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Fresh versions that are not known yet, each once."""
    return fresh.dropDuplicates([*keys, *order]).join(known.select(*keys, *order), [*keys, *order], "left_anti")


def late_delta(known: DataFrame, fresh: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``(op, keys, order, field_name, old_value, new_value)`` of fresh versions, late ones among them."""
    columns = [*keys, *order, *fields]
    touched = known.select(*columns).join(fresh.select(*keys).distinct(), list(keys), "left_semi")
    both = touched.withColumn("is_fresh", F.lit(0)).unionByName(fresh.select(*columns).withColumn("is_fresh", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(*order)
    # the known versions on both sides of a run of fresh ones, however long it is
    before = F.lag("is_fresh").over(w)
    after = F.lead("is_fresh").over(w)
    near = both.withColumns({"before": before, "after": after}).filter((F.col("is_fresh") == 1) | (F.col("before") == 1) | (F.col("after") == 1))
    # stretches of neighbours must not touch each other: a version that opens one has no event with the stretch before
    opens = (F.col("is_fresh") == 0) & (F.coalesce("before", F.lit(0)) == 0)
    stretch = near.withColumn("stretch", F.sum(F.when(opens, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = [*keys, "stretch"]
    old = change_rows(stretch.filter("is_fresh = 0"), inner, order, fields).drop("stretch")
    new = change_rows(stretch, inner, order, fields).drop("stretch")
    shape = [*keys, *order, *CHANGE]
    signed = old.select(F.lit(-1).alias("op"), *shape).unionByName(new.select(F.lit(1).alias("op"), *shape))
    # an event that both sides have stays as it is
    return signed.groupBy(*shape).agg(F.sum("op").cast("int").alias("op")).filter("op <> 0").select("op", *shape)


def apply_delta(events: DataFrame, delta: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The events after a delta."""
    shape = [*keys, *order, *CHANGE]
    signed = events.select(*shape, F.lit(1).alias("op")).unionByName(delta.select(*shape, "op"))
    return signed.groupBy(*shape).agg(F.sum("op").alias("op")).filter("op > 0").select(*shape)


class ChangeLog:
    """Versions and change events in a folder, kept up by batches in any order of arrival.

    A batch writes its fresh versions and its signed delta as one numbered folder each; the versions
    come last, and a batch whose versions stand is done.  A batch that is run again before that
    overwrites what it left.  ``events`` nets the deltas.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], carry: Sequence[str] = ()):
        """``carry``: columns that are stored with a version and make no change event."""
        self.spark, self.path, self.keys, self.order, self.fields, self.carry = spark, path.rstrip("/"), list(keys), list(order), list(fields), list(carry)

    def _read(self, what: str, like: DataFrame | None = None) -> DataFrame | None:
        place = f"{self.path}/{what}"
        return self.spark.read.parquet(place) if exists(self.spark, place) else None if like is None else like.limit(0)

    def add(self, batch: DataFrame, number: int) -> None:
        """Take a batch of versions; ``number`` names it, so a repeated batch counts once."""
        if exists(self.spark, f"{self.path}/versions/batch={number}/_SUCCESS"):
            return
        rows = batch.select(*self.keys, *self.order, *self.fields, *self.carry)
        known = self._read("versions", rows.withColumn("batch", F.lit(number))).filter(F.col("batch") < number).drop("batch")
        fresh = materialize(unknown(known, rows, self.keys, self.order), "fresh")
        late_delta(known, fresh, self.keys, self.order, self.fields).write.mode("overwrite").parquet(f"{self.path}/delta/batch={number}")
        fresh.write.mode("overwrite").parquet(f"{self.path}/versions/batch={number}")
        discard(fresh)

    def versions(self) -> DataFrame:
        return self._read("versions").drop("batch")

    def events(self) -> DataFrame:
        """Change events of all versions taken so far."""
        done = self._read("versions").select("batch").distinct()
        shape = [*self.keys, *self.order, *CHANGE]
        return self._read("delta").join(done, "batch", "left_semi").groupBy(*shape).agg(F.sum("op").alias("op")).filter("op > 0").select(*shape)

    def take(self, stream: DataFrame, checkpoint: str):
        """A streaming query that adds what has arrived and ends."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
