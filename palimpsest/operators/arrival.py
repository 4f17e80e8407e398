"""Resolution of records in order of arrival.

Each record is linked, queued or made a new master by what arrived before it:

* ``linked``: an identifier of a mapped record is shared, and it is a registry number or sure enough;
* ``queued``: only a weak identifier or a similar title leads to a master; the record is not mapped;
* ``created``, ``created_via_aggregator``: nothing leads anywhere; the record is its own master.

The outcome depends on the order, so it is a fold.  Only records that share an identifier or a
similar title can influence each other: connected parts of that graph are folded independently, each as a
sorted stream of rows.  A part's state holds its masters by identifier; no part is held as rows.
Identifiers of one record alone are left out before anything is shuffled.

Order: ``order`` columns, then the record.  A record's matches are its identifiers in order of
extraction, the masters of one identifier in the order in which they got it; the first match of a
master counts, sure matches come before others, then the higher confidence.  Titles are asked only
where no identifier is sure.  Null and repeated identifiers of a record count once or not at all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize
from .components import connected_components
from .resolve import AUTO, REGISTRY_TYPES, identifier_pairs

RESOLVED = "record long, action string, master long, method string, confidence double"


class PartState:
    """What the records of one part so far leave behind."""

    def __init__(self):
        self.masters: dict[tuple[str, str], dict[int, None]] = {}  # masters of an identifier, in order
        self.of: dict[int, int] = {}  # master of a mapped record

    def matches(self, identifiers: list[tuple], titles: list[tuple]) -> list[tuple]:
        """``(sure, confidence, master, method)``, best first."""
        found: dict[int, tuple] = {}
        for kind, value, confidence in identifiers:
            for master in self.masters.get((kind, value), ()):
                found.setdefault(master, (kind in REGISTRY_TYPES or confidence >= AUTO, confidence, f"identifier_match {kind}"))
        if not any(m[0] for m in found.values()):
            best: dict[int, float] = {}
            for other, ratio in titles:
                master = self.of.get(other)
                if master is not None and master not in found:
                    best[master] = max(ratio, best.get(master, 0.0))
            for master in sorted(best):
                found[master] = (False, round(best[master], 4), "title_similarity")
        return sorted(((sure, confidence, master, method) for master, (sure, confidence, method) in found.items()), key=lambda m: (not m[0], -m[1]))

    def resolve(self, record: int, aggregator: bool, identifiers: list[tuple], titles: list[tuple]) -> tuple:
        """``(record, action, master, method, confidence)``; what it maps is known to later records."""
        matches = self.matches(identifiers, titles)
        if matches and not matches[0][0]:
            return record, "queued", matches[0][2], matches[0][3], matches[0][1]
        master, method, confidence = (matches[0][2], matches[0][3], matches[0][1]) if matches else (record, "first_record", 1.0)
        self.of[record] = master
        for kind, value, _ in identifiers:
            self.masters.setdefault((kind, value), {}).setdefault(master)
        return record, "linked" if matches else "created_via_aggregator" if aggregator else "created", master, method, confidence


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, state = None, PartState()
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            if r.part != part:
                part, state = r.part, PartState()
            identifiers = [(x["type"], x["value"], x["confidence"]) for x in r.identifiers]
            titles = [(int(x["other"]), x["ratio"]) for x in r.titles]
            out.append(state.resolve(int(r.record), bool(r.aggregator), identifiers, titles))
        yield pd.DataFrame(out, columns=["record", "action", "master", "method", "confidence"])


def resolve_in_order(records: DataFrame, identifiers: DataFrame, record: str, order: Sequence[str], aggregator: str | None = None, titles: DataFrame | None = None) -> DataFrame:
    """``(record, action, master, method, confidence)``, one row per record.

    ``records``: ``record`` (long, unique), ``order`` and ``aggregator`` (boolean).  ``identifiers``:
    ``(record, type, value, confidence, nth)``.  ``titles``: ``(a, b, ratio)``, similar pairs in either
    direction.
    """
    given = identifiers.select(F.col(record).alias("record"), "type", "value", "confidence", "nth").filter("record is not null and type is not null and value is not null")
    once = given.groupBy("record", "type", "value").agg(F.min_by("confidence", "nth").alias("confidence"), F.min("nth").alias("nth"))
    pairs = identifier_pairs(once, "record").select("a", "b")
    if titles is not None:
        pairs = pairs.unionByName(titles.select("a", "b").filter("a <> b"))
    parts = connected_components(pairs)
    shared = once.groupBy("type", "value").agg(F.count("*").alias("holders")).filter("holders > 1").select("type", "value")
    own = once.join(shared, ["type", "value"], "left_semi").groupBy("record").agg(F.array_sort(F.collect_list(F.struct("nth", "type", "value", "confidence"))).alias("identifiers"))
    rows = records.select(F.col(record).cast("long").alias("record"), F.struct(*order, F.col(record)).alias("arrival"), (F.coalesce(F.col(aggregator), F.lit(False)) if aggregator else F.lit(False)).alias("aggregator"))
    whole = rows.join(parts.select(F.col("node").alias("record"), F.col("component").alias("part")), "record", "left").join(own, "record", "left")
    none = F.array().cast("array<struct<other:long,ratio:double>>")
    if titles is not None:
        either = titles.select(F.col("a").alias("record"), F.col("b").alias("other"), "ratio").unionByName(titles.select(F.col("b").alias("record"), F.col("a").alias("other"), "ratio"))
        near = either.filter("record <> other").groupBy("record").agg(F.collect_list(F.struct(F.col("other").cast("long").alias("other"), F.col("ratio").cast("double").alias("ratio"))).alias("titles"))
        whole = whole.join(near, "record", "left").withColumn("titles", F.coalesce("titles", none))
    else:
        whole = whole.withColumn("titles", none)
    no_ids = F.array().cast("array<struct<nth:int,type:string,value:string,confidence:double>>")
    held = whole.select("record", F.coalesce("part", "record").alias("part"), "arrival", "aggregator", F.coalesce(F.col("identifiers").cast("array<struct<nth:int,type:string,value:string,confidence:double>>"), no_ids).alias("identifiers"), "titles")
    # a record alone in its part needs no fold
    done = materialize(held.repartition("part").sortWithinPartitions("part", "arrival").drop("arrival").mapInPandas(_fold, RESOLVED), "resolved")
    discard(parts)
    return done


def outcome_counts(resolved: DataFrame) -> DataFrame:
    """``(action, n)`` of a run."""
    return resolved.groupBy("action").agg(F.count("*").alias("n"))
