"""A bitmap of hashed keys, of bounded size, that spares large rows a shuffle.

Before large rows (whole texts) are joined with a selective set of keys, the set is
written as a bitmap of at most ``MAX_BUCKETS`` times 4 KiB.  That bound holds at any
input size, so it may be broadcast; rows whose bit is not set need not take part in
the join.  A full bitmap only lets more rows through: the join after it is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32_768  # of one aggregated bitmap
MAX_BUCKETS = 2_048


def free_name(name: str, taken: set[str]) -> str:
    """``name``, with underscores before it until it is not among ``taken`` (in lower case)."""
    while name.lower() in taken:
        name = f"_{name}"
    return name


class KeyBitmap:
    """The bitmap of a table of keys, given as a hash column."""

    def __init__(self, keys: DataFrame, hashed: Column, per_key: int = 16):
        n = keys.count()
        self.buckets = 1
        while self.buckets < MAX_BUCKETS and self.buckets * BITS < n * per_key:
            self.buckets *= 2
        bit = F.pmod(hashed, F.lit(self.buckets * BITS))
        self.table = keys.select(F.floor(bit / BITS).cast("int").alias("bucket"), (bit % BITS).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))

    def to_bytes(self) -> bytes:
        """The whole bitmap, ``buckets * BITS / 8`` bytes: bit ``pmod(hashed, 8 * length)``, lowest first."""
        blocks = {r["bucket"]: bytes(r["bitmap"]) for r in self.table.collect()}  # MAX_BUCKETS rows at most
        return b"".join(blocks.get(k, bytes(BITS // 8)) for k in range(self.buckets))

    def mark(self, df: DataFrame, hashed: Column, name: str = "maybe") -> DataFrame:
        """``df`` with a boolean column ``name``: whether the row's key may be among the keys.

        Own columns get names that ``df`` does not use.
        """
        taken = {c.lower() for c in df.columns} | {name.lower()}
        bucket, bitmap, place = (free_name(c, taken) for c in ("bucket", "bitmap", "place"))
        small = self.table.withColumnsRenamed({"bucket": bucket, "bitmap": bitmap})
        spot, within = F.col(place), F.col(place) % BITS
        byte = F.coalesce(F.conv(F.hex(F.substring(bitmap, F.floor(within / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int"), F.lit(0))
        hit = F.call_function("shiftright", byte, (spot % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
        return (
            df.withColumn(place, F.pmod(hashed, F.lit(self.buckets * BITS)))
            .withColumn(bucket, F.floor(spot / BITS).cast("int"))
            .join(F.broadcast(small), bucket, "left")
            .withColumn(name, hit)
            .drop(place, bucket, bitmap)
        )
