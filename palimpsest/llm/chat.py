"""Chat formatting after the collapse of cumulative snapshots.

Loggers store a conversation again after each turn, so shorter rows of turns repeat
the start of longer ones.  Every turn gets 128 hash bits of turn number, role and text;
its prefix hash is their running exclusive-or, with the number of turns.  A
conversation whose full hash is a prefix hash of a longer one is anti-joined away,
and of equal ones the smallest conv_id stays.  What remains is rendered.

All of it is DataFrame functions.  Up to the rendering only hashes are shuffled.  Running
values go in two levels, within blocks of ``BLOCK`` turn numbers and over the blocks, so no
task holds a whole long conversation.  The texts are shuffled once, to the block they are
rendered in; a bounded bitmap keeps most texts of collapsed conversations out of it, and a
row per kept block in the same grouping decides exactly.

Defined results.  Rows repeated in all of conv_id, turn, role and text count once.
Turns of one number stand in the order of role and text.  A null turn stands before
all others, null role and text are rendered as empty but differ from empty ones.  A row
without a conv_id is a conversation of one turn, with a null conv_id in the result; of
equal ones, and beside an equal one with an id, one stays.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefilter import KeyBitmap
from ..storage import discard, materialize

#: Turn numbers of a part: the unit of running hashes and of rendering.
BLOCK = 512
_FIRST = -(1 << 62)


def _block(turn: Column) -> Column:
    return F.floor(turn / BLOCK)


def _hash(seed: int) -> Column:
    known = [F.coalesce(F.col(c), F.lit("")) for c in ("role", "text")]
    return F.xxhash64(F.lit(seed), F.col("turn"), *known, F.col("role").isNull(), F.col("text").isNull())


def _turns(conversations: DataFrame) -> DataFrame:
    """The rows with their hashes; ``lone`` names a row without a conv_id."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(_FIRST)).alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    hashed = rows.withColumns({"a": _hash(1), "b": _hash(2)})
    return hashed.withColumn("lone", F.when(F.col("conv_id").isNull(), F.concat(F.hex("a"), F.lit("-"), F.hex("b"))))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, n, a, b, total)``: hash of all turns up to this one, and their number in all.

    ``turns`` holds conv_id, turn and the hashes a and b; rows without a conv_id are left out.
    """
    rows = turns.filter("conv_id is not null").select("conv_id", "turn", "a", "b").distinct()
    each = rows.withColumn("block", _block(F.col("turn"))).repartition("conv_id", "block").groupBy("conv_id", "block", "turn").agg(F.count("*").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn")
    running = each.select("conv_id", "block", "turn", F.sum("n").over(inside).alias("n"), *[F.bit_xor(c).over(inside).alias(c) for c in "ab"])
    sums = each.groupBy("conv_id", "block").agg(F.sum("n").alias("n"), *[F.bit_xor(c).alias(c) for c in "ab"])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    before = [F.coalesce(f(c).over(earlier), F.lit(0)).alias(f"{c}0") for c, f in (("n", F.sum), ("a", F.bit_xor), ("b", F.bit_xor))]
    starts = sums.select("conv_id", "block", *before, F.sum("n").over(whole).alias("total"))
    return running.join(starts, ["conv_id", "block"]).select("conv_id", "turn", (F.col("n") + F.col("n0")).alias("n"), *[F.col(c).bitwiseXOR(F.col(f"{c}0")).alias(c) for c in "ab"], "total")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, lone, block)`` of the conversations that are no prefix of another, one of equal ones."""
    prefixes = materialize(prefix_hashes(turns), "prefixes")
    ids = ["n", "a", "b"]
    single = turns.filter("conv_id is null").select("conv_id", F.lit(1).cast("long").alias("n"), "a", "b", "lone")
    full = prefixes.filter("n = total").select("conv_id", *ids, F.lit(None).cast("string").alias("lone")).unionByName(single)
    # equal conversations become one row, and equal prefixes too, before they meet
    firsts = full.groupBy(*ids).agg(F.min("conv_id").alias("conv_id"), F.min("lone").alias("lone"))
    longer = prefixes.filter("n < total").select(*ids).distinct()
    kept = materialize(firsts.join(longer, ids, "left_anti").select("conv_id", F.when(F.col("conv_id").isNull(), F.col("lone")).alias("lone"), F.col("n").alias("turns")), "maximal")
    blocks = prefixes.select("conv_id", _block(F.col("turn")).alias("block")).distinct()
    named = kept.filter("conv_id is not null").join(blocks, "conv_id").select("conv_id", "lone", "block")
    lone = kept.filter("conv_id is null").join(turns.filter("conv_id is null").select("lone", _block(F.col("turn")).alias("block")).distinct(), "lone").select("conv_id", "lone", "block")
    out = materialize(named.unionByName(lone), "kept")
    discard(prefixes), discard(kept)
    return out


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """``(conv_id, part, n_turns, rendered)``: the kept blocks of turns, in order."""
    empty = F.lit("")
    who = F.xxhash64("conv_id", "lone")
    wanted = KeyBitmap(kept, who).mark(turns, who).filter("maybe")
    row = F.struct("turn", F.coalesce("role", empty).alias("r"), F.coalesce("text", empty).alias("t"), F.col("role").isNull().alias("no_role"), F.col("text").isNull().alias("no_text"))
    texts = wanted.select("conv_id", "lone", _block(F.col("turn")).alias("part"), row.alias("row"), F.lit(False).alias("kept"))
    marks = kept.select("conv_id", "lone", F.col("block").alias("part"), F.lit(None).cast(texts.schema["row"].dataType).alias("row"), F.lit(True).alias("kept"))
    line = lambda x: F.concat(F.lit("<|"), x["r"], F.lit("|>\n"), x["t"], F.lit("<|end|>\n"))
    grouped = texts.unionByName(marks).groupBy("conv_id", "lone", "part").agg(F.max("kept").alias("kept"), F.array_sort(F.array_distinct(F.collect_list("row"))).alias("rows"))
    return grouped.filter("kept").select("conv_id", "part", F.size("rows").cast("long").alias("n_turns"), F.array_join(F.transform("rows", line), "").alias("rendered"))


def whole_conversations(parts: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, rendered)`` of rendered parts: a row per conv_id, for those that fit in one row."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "rendered"))), lambda p: p["rendered"]), "")
    known = parts.filter("conv_id is not null").groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), text.alias("rendered"))
    return known.unionByName(parts.filter("conv_id is null").select("conv_id", "n_turns", "rendered"))


def chat_texts(conversations: DataFrame) -> DataFrame:
    """The rendered maximal conversations, in parts of ``BLOCK`` turn numbers."""
    turns = _turns(conversations)
    return render(turns, maximal_conversations(turns))


CHAT_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text, coalesce(CAST(conv_id AS VARCHAR), concat_ws('|', 'row', turn, coalesce(role, '?null'), coalesce(text, '?null'))) AS who
  FROM (SELECT conv_id, coalesce(turn, -4611686018427387904) AS turn, role, text FROM conversations)
), p AS (
  SELECT a.who, a.turn, count(*) AS n,
         md5(string_agg(md5(concat_ws('|', b.turn, coalesce(b.role, '?null'), coalesce(b.text, '?null'))), '' ORDER BY b.turn, b.role, b.text)) AS h
  FROM (SELECT DISTINCT who, turn FROM t) a JOIN t b ON a.who = b.who AND b.turn <= a.turn
  GROUP BY a.who, a.turn
), s AS (
  SELECT *, max(n) OVER (PARTITION BY who) AS total FROM p
), f AS (
  SELECT s.who, n, h, conv_id FROM s JOIN (SELECT DISTINCT who, conv_id FROM t) USING (who) WHERE n = total
), k AS (
  SELECT arg_min(who, coalesce(conv_id, 9223372036854775807)) AS who FROM f
  WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.h = f.h AND s.n = f.n AND s.total > f.n)
  GROUP BY n, h
)
SELECT t.conv_id, CAST(floor(turn / 512.0) AS BIGINT) AS part, count(*) AS n_turns,
       string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS rendered
FROM t JOIN k USING (who)
GROUP BY t.conv_id, t.who, 2
"""
