"""Write semantics that unique keys give elsewhere, as explicit operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .versions import first_seen, latest


def insert_ignore(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows to append: the first of each key that is not there yet."""
    return first_seen(new, keys, order).join(existing.select(*keys), list(keys), "left_anti").select(*new.columns)


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole table after replacing rows of known keys; the highest order wins, new rows on ties."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return latest(both, keys, [*order, "__new"]).drop("__new")


def insert_if_no_pending(existing: DataFrame, new: DataFrame, keys: Sequence[str], state: str = "state", pending: str = "pending", order: Sequence[str] = ()) -> DataFrame:
    """Rows to append whose key has no pending row."""
    return insert_ignore(existing.filter(F.col(state) == pending), new, keys, order or list(keys))


def count_attempt(queue: DataFrame, failed: Column, limit: int = 3) -> DataFrame:
    """Attempts one up where failed; the state turns ``failed`` at the limit."""
    tries = F.col("attempts") + F.when(failed, 1).otherwise(0)
    return queue.withColumn("state", F.when(failed & (tries >= limit), "failed").otherwise(F.col("state"))).withColumn("attempts", tries)


def restore_full_versions(versions: DataFrame, keys: Sequence[str], order: Sequence[str], stub: Column, id_col: str) -> DataFrame:
    """Chains in which full versions outrank stubs, renumbered."""
    from .versions import version_chain

    return version_chain(versions.withColumn("__stub", stub.cast("int")), keys, [F.desc("__stub"), *order], id_col).drop("__stub")


def without_phantoms(events: DataFrame, phantoms: DataFrame, key: str) -> DataFrame:
    return events.join(phantoms.select(key), key, "left_anti")


def merge_fresh(session: DataFrame, batch: DataFrame, key: str, preview: int = 200) -> tuple[DataFrame, DataFrame]:
    """A live session after a batch (rows of unknown ids appended), and its bounded preview."""
    merged = session.unionByName(insert_ignore(session, batch, [key], [key]))
    return merged, merged.orderBy(key).limit(preview)
