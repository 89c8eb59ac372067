"""Connected components as joins and aggregations: alternating large-star and small-star rounds.

Every round is a min per node and a join back, so that a hub's edges are never gathered in one task: the
aggregation folds in the map tasks and the join has one row per node on its other side, which is broadcast while the
counted edges are few and else leaves a hub's partition for Spark to split. State goes through a
reliable checkpoint each round. The driver sees two numbers a round, never links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawmill.session import materialise

MAX_ROUNDS = 60
BROADCAST_EDGES = 200_000


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """One star operation over (u, v) with v < u; returns links (u, v) with v < u."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(F.broadcast(least) if few else least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v"))


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link, root being the smallest node reachable.

    Self links and repeats are allowed, null ends are ignored; no links give no rows.
    """
    edges = materialise(
        links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    for _ in range(MAX_ROUNDS):
        few = edges.limit(BROADCAST_EDGES + 1).count() <= BROADCAST_EDGES
        after = materialise(_star(_star(edges, True, few), False, few).distinct())
        # done when every node hangs on exactly one root that hangs on nothing
        state = after.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        many = state.filter(F.col("n") > 1).limit(1).count()
        deep = 0 if many else after.select(F.col("v").alias("u")).join(F.broadcast(state) if few else state, "u", "left_semi").limit(1).count()
        edges = after
        if not many and not deep:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
