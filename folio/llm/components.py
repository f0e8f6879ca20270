"""Connected components of an edge table by alternating large-star and small-star steps.

Each round replaces the edges by at most as many, linked to smaller nodes,
with two aggregates; the rounds grow with the logarithm of the longest path.
Edges stay in Spark: only counts and the hot nodes reach the driver. A node
with more than ``1 / SALTS`` of all edges (there are ``2 * SALTS`` at most, found
by ``approx_top_k``, Spark's frequent-items sketch) has its edges dealt to
``SALTS`` tasks and its one row of the other side copied to each; its ``min`` is
summed in the tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import materialise

#: Tasks that share the edges of a hot node.
SALTS = 256
#: Fewer edges of a node than this are not worth dealing out.
LEAST_HOT = 1000


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its smallest node.

    Null ends and self links are ignored; an empty table has no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a > b").distinct()
    e = materialise(e, "edges")
    for _ in range(rounds):
        if e.isEmpty():
            break
        hot_a, hot_b = hot_nodes(e, "a"), hot_nodes(e, "b")
        # Large star: every node's larger neighbours go to the smallest of its neighbourhood.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        large = with_low(e, "b", low, hot_b).select("a", F.least("b", "m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of those. No node has more of them than before.
        small_low = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        small = with_low(large, "a", small_low, hot_a).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a > b").distinct()
        new = materialise(small, "edges")
        # A fixed point has the same edges: stars only, every node linked to its component.
        same = new.count() == e.count() and new.join(e, ["a", "b"], "left_anti").isEmpty()
        e = new
        if same:
            break
    else:
        raise RuntimeError(f"components: not done after {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def hot_nodes(edges: DataFrame, end: str) -> list:
    """Hashes of the nodes with more than ``1 / SALTS`` of the rows of ``edges`` at this end; their number is bounded by that share."""
    top = edges.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(xxhash64({end}), {2 * SALTS}, {32 * SALTS})").alias("top")).first()
    return [t["item"] for t in top["top"] if t["count"] >= max(LEAST_HOT, top["n"] / SALTS)]


def with_low(edges: DataFrame, end: str, low: DataFrame, hot: list) -> DataFrame:
    """``edges`` with ``m`` of the node at this end, from one row (node, m) per node."""
    if not hot:
        return edges.join(low, F.col(end) == F.col("node"))
    other = "a" if end == "b" else "b"
    dealt = edges.withColumn("__salt", F.when(F.xxhash64(end).isin(hot), F.pmod(F.xxhash64(other), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    copies = F.when(F.xxhash64("node").isin(hot), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return dealt.join(low.withColumn("__copy", F.explode(copies)), (F.col(end) == F.col("node")) & (F.col("__salt") == F.col("__copy")))
