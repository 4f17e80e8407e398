"""The same operators on streams: change detection, deduplication, windows, outbox."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.writes import insert_ignore
from ..storage import exists


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A file stream; timestamps without zone become UTC timestamps, as watermarks need."""
    df = spark.readStream.schema(schema).parquet(path)
    return df.withColumns({n: F.col(n).cast("timestamp") for n, t in df.dtypes if t == "timestamp_ntz"})


def windowed_counts(events: DataFrame, ts: str, keys: Sequence[str], length: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Tumbling or sliding counts with late data up to ``late``."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.withWatermark(ts, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, ts: str, keys: Sequence[str], gap: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))


def first_hashes(events: DataFrame, ts: str, hash_col: str, late: str = "1 day") -> DataFrame:
    """One row per hash within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([hash_col])


CHANGES = "key string, event_id long, field_name string, old_value string, new_value string, version_number long"


def stream_changes(events: DataFrame, key: str, ts: str, event_id: str, field: str) -> DataFrame:
    """Changes of one field per key, against the state of the key's last version.

    Rows of a micro-batch are taken in the order of (time, id); the state is the last
    value and the version number, a few bytes per key.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, version = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames), ignore_index=True).sort_values([ts, event_id])
        out = []
        for r in rows.itertuples(index=False):
            new = getattr(r, field)
            if version and new == value:
                continue
            version += 1
            if version > 1:
                out.append((str(k[0]), int(getattr(r, event_id)), field, value, new, version))
            value = new
        state.update((value, version))
        yield pd.DataFrame(out, columns=["key", "event_id", "field_name", "old_value", "new_value", "version_number"])

    return events.groupBy(key).applyInPandasWithState(step, CHANGES, "value string, version long", "append", GroupStateTimeout.NoTimeout)


def write_once(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str]):
    """A query that appends each key once, whatever is replayed."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        known = spark.read.parquet(path) if exists(spark, path) else df.limit(0)
        insert_ignore(known, df, keys, order).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
