"""Intermediate tables in the folder that the whole cluster shares.

Operators that need a result twice, or that iterate, write it as Parquet below
``spark.checkpoint.dir`` and read it back.  That cuts the lineage, survives the
loss of executors and needs no executor-local copy.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is named and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
        raise ValueError("spark.checkpoint.dir names no shared folder")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="palimpsest-"))
    return _OWN[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is stored at ``path``; errors of the file system are raised."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def discard(df: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
