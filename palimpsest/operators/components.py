"""Connected components of an edge table, by alternating stars.

Every pass is one partial aggregation and one join on a node, so a hub with very
many neighbours is a plain skewed equi-join that adaptive execution can split.
Each pass is written to the shared folder; nothing is collected but two numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy(F.col("u").alias("w")).agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return edges.join(low, F.col("v") == F.col("w")).select("u", F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge; component: its smallest node.

    Self-loops and rows with a null end are ignored; repeated edges do no harm.  The result
    reads one stored table, which ``storage.discard`` deletes.
    """
    state = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
        .distinct(),
        "components",
    )
    while True:
        after = materialize(_small_star(_large_star(state)), "components")
        discard(state)
        state = after
        rows = state.agg(F.count("*").alias("n"), F.count_distinct("u").alias("d")).first()
        roots = state.select(F.col("v").alias("u")).distinct()
        if rows["n"] == rows["d"] and state.join(roots, "u", "left_semi").isEmpty():
            break  # every node hangs on one root, and no root hangs on another
    roots = state.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
