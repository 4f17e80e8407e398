"""A trigram index over time: stored postings, batches of changes, compaction.

A batch holds the postings of inserted or changed texts and the keys it touched.  A posting counts if no
later batch touched its key, so a changed text drops its old postings and a deleted key all of them
without rewriting anything.  Compaction writes the postings that count as one batch, numbered as the last
one it covers; what it covers is then ignored and may be removed.  A batch is there once its last file, the
mark, is; a batch that is written again before that replaces itself.

Searches intersect the postings of a phrase's trigrams and check the text; phrases below three
characters have no trigram and are scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trigrams


class TrigramIndex:
    def __init__(self, spark: SparkSession, path: str, key: str, text: str):
        self.spark, self.path, self.key, self.text = spark, path.rstrip("/"), key, text

    def _at(self, place: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{place}")

    def _files(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _marks(self, kind: str) -> list[int]:
        files = self._files()
        if not files.exists(self._at("marks")):
            return []
        names = [s.getPath().getName() for s in files.listStatus(self._at("marks"))]
        return sorted(int(n.split("-")[1]) for n in names if n.startswith(kind + "-"))

    def _mark(self, kind: str, number: int) -> None:
        self._files().create(self._at(f"marks/{kind}-{number}"), True).close()

    def _folders(self) -> tuple[int, list[int]]:
        """The newest compaction (0: none) and the batches after it."""
        base = max(self._marks("base"), default=0)
        return base, [n for n in self._marks("batch") if n > base]

    def apply(self, number: int, upserts: DataFrame, deletes: DataFrame | None = None) -> None:
        """Take texts that are new or changed, and keys that are gone, as batch ``number`` (from 1, rising).

        A key that is in both is there afterwards.  A batch taken before is not taken again.
        """
        if number < 1:
            raise ValueError("batches are numbered from 1")
        if number in self._marks("batch"):
            return
        if number <= max(max(self._marks("batch"), default=0), max(self._marks("base"), default=0)):
            raise ValueError(f"batch {number} comes after a later one")
        rows = upserts.select(F.col(self.key).alias("key"), F.explode(trigrams(F.col(self.text))).alias("gram"))
        rows.distinct().write.mode("overwrite").parquet(f"{self.path}/postings/batch={number}")
        touched = upserts.select(F.col(self.key).alias("key"))
        if deletes is not None:
            touched = touched.unionByName(deletes.select(F.col(self.key).alias("key")))
        touched.distinct().write.mode("overwrite").parquet(f"{self.path}/touched/batch={number}")
        self._mark("batch", number)

    def postings(self) -> DataFrame:
        """``(key, gram)`` of the texts as they are now."""
        base, batches = self._folders()
        if not base and not batches:
            raise FileNotFoundError(f"no batch in {self.path}")
        read = lambda what, n: self.spark.read.parquet(f"{self.path}/{what}/batch={n}").withColumn("batch", F.lit(n))
        parts = [self.spark.read.parquet(f"{self.path}/base/batch={base}").withColumn("batch", F.lit(base))] if base else []
        parts += [read("postings", n) for n in batches]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        if not batches:
            return every.select("key", "gram")
        touched = read("touched", batches[0])
        for n in batches[1:]:
            touched = touched.unionByName(read("touched", n))
        last = touched.groupBy("key").agg(F.max("batch").alias("last"))
        return every.join(last, "key", "left").filter(F.col("last").isNull() | (F.col("batch") >= F.col("last"))).select("key", "gram")

    def compact(self) -> None:
        """Write what counts as one base and remove what it covers."""
        base, batches = self._folders()
        if not batches:
            return
        self.postings().repartition("gram").sortWithinPartitions("gram", "key").write.mode("overwrite").parquet(f"{self.path}/base/batch={batches[-1]}")
        self._mark("base", batches[-1])
        files = self._files()
        for n in batches:
            files.delete(self._at(f"postings/batch={n}"), True)
            files.delete(self._at(f"touched/batch={n}"), True)
        if base:
            files.delete(self._at(f"base/batch={base}"), True)

    def candidates(self, phrase: str) -> DataFrame | None:
        """Keys of the texts that hold every trigram of a phrase; None for phrases without one."""
        low = phrase.lower()
        grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
        if not grams:
            return None
        hits = self.postings().filter(F.col("gram").isin(grams)).distinct()
        return hits.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select(F.col("key").alias(self.key))

    def search(self, records: DataFrame, phrase: str, text: Column | None = None) -> DataFrame:
        """The records that contain the phrase, upper and lower case being equal."""
        hit = F.lower(F.col(self.text) if text is None else text).contains(phrase.lower())
        found = self.candidates(phrase)
        return records.filter(hit) if found is None else records.join(found, self.key, "left_semi").filter(hit)


