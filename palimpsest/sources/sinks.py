"""Sinks: JSON and CSV exports, text reports, an archive, and an idempotent outbox."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import exists

BOM = "\ufeff"


def json_export(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines; ``by`` makes a folder per value."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def keyed_details(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(key, detail)``: each record as JSON text under ``source:id``."""
    return df.select(F.concat_ws(":", *keys).alias("key"), F.to_json(F.struct(*df.columns)).alias("detail"))


def csv_rows(df: DataFrame, separator: str = "; ") -> DataFrame:
    """Lists joined into one cell, null as an empty cell."""
    cells = [F.array_join(F.col(c).cast("array<string>"), separator).alias(c) if t.startswith("array") else F.col(c).cast("string").alias(c) for c, t in df.dtypes]
    return df.select(*[F.coalesce(c, F.lit("")).alias(n) for c, n in zip(cells, df.columns)])


def csv_export(df: DataFrame, path: str) -> None:
    """CSV part files with a header that starts with a byte order mark."""
    rows = csv_rows(df)
    first = rows.columns[0]
    rows.withColumnRenamed(first, BOM + first).write.mode("overwrite").csv(path, header=True, encoding="UTF-8", emptyValue="")


def archive(df: DataFrame, path: str, by: str = "source") -> None:
    """The raw records, a folder per source."""
    df.write.mode("append").partitionBy(by).parquet(path)


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A page of a result as Markdown; the bound is the page's size."""
    rows = df.limit(limit).collect()
    clean = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(clean(v) for v in r) + " |" for r in rows])


def digest_rows(counts: DataFrame, group: str, n: str) -> DataFrame:
    """``(n, line)``: one line per group, for digests of any number of groups."""
    return counts.select(F.col(n).alias("n"), F.concat(F.lit("- "), F.col(group).cast("string"), F.lit(": "), F.col(n).cast("string")).alias("line"))


def digest_text(counts: DataFrame, group: str, n: str, title: str, most: int = 1000) -> str:
    """A heading and one line per group.  It is never cut: beyond ``most`` groups it fails, and ``digest_rows`` is to be written."""
    rows = counts.orderBy(F.desc(n), group).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} groups: write digest_rows")
    return "\n".join([title, *[f"- {r[group]}: {r[n]}" for r in rows]])


def deliver(pending: DataFrame, path: str, keys: Sequence[str], send: Callable[[DataFrame], None]) -> int:
    """Send what the ledger at ``path`` doesn't know, then enter it; a second run sends nothing."""
    spark = pending.sparkSession
    done = spark.read.parquet(path).select(*keys) if exists(spark, path) else pending.select(*keys).limit(0)
    fresh = pending.dropDuplicates(list(keys)).join(done, list(keys), "left_anti")
    n = fresh.count()
    if n:
        send(fresh)
        fresh.select(*keys).write.mode("append").parquet(path)
    return n


def _content(df: DataFrame) -> tuple[int, int]:
    """Number of rows and a sum over their hashes, whatever their order."""
    row = df.select(F.xxhash64(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("s")).first()
    return row["n"], int(row["s"] or 0)


def snapshots(spark: SparkSession, root: str) -> list[str]:
    """Stamps of the complete snapshots, oldest first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []
    return [n for n in names if exists(spark, f"{root.rstrip('/')}/{n}/_SUCCESS") and exists(spark, f"{root.rstrip('/')}/{n}.verified")]


def snapshot(df: DataFrame, root: str, stamp: str, keep: int = 7) -> str:
    """A backup as a folder of its own, verified by reading it again; the newest ``keep`` stay.

    A snapshot that reads otherwise than ``df`` is deleted, and the call fails; older ones stay then.
    Only complete and verified snapshots are listed, restored or removed.
    """
    spark, path = df.sparkSession, f"{root.rstrip('/')}/{stamp}"
    df.write.mode("error").parquet(path)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if _content(spark.read.schema(df.schema).parquet(path)) != _content(df):
        files.delete(at(path), True)
        raise RuntimeError(f"snapshot {stamp} differs from what was to be stored")
    files.create(at(f"{path}.verified"), True).close()
    for old in snapshots(spark, root)[: -max(1, keep)]:
        files.delete(at(f"{root.rstrip('/')}/{old}.verified"), False)
        files.delete(at(f"{root.rstrip('/')}/{old}"), True)
    return path


def restore(spark: SparkSession, root: str, stamp: str | None = None) -> DataFrame:
    """The rows of a snapshot, by default of the newest."""
    known = snapshots(spark, root)
    if not known or (stamp is not None and stamp not in known):
        raise FileNotFoundError(f"no snapshot {stamp or ''} in {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/{stamp or known[-1]}")
