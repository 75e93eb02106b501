"""Connected components of a distributed edge list by alternating large-star
and small-star steps: every step is a minimum per node and a join, edges stay
at most as many as they were, and a few rounds suffice whatever the diameter.
Each round is checkpointed to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import use_checkpoints


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Links the neighbours of each node ``u`` (the larger ones, or the smaller
    ones and itself) to the smallest of them and itself."""
    least = pairs.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    linked = pairs.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        # the smallest neighbour would only be linked to itself; its row links the node
        out = linked.select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v"))
    return out.where("u <> v").distinct()


def _both_ways(pairs: DataFrame, *names: str) -> DataFrame:
    """Each pair (u, v) and its reverse, from one pass over the pairs: a union would start twice the tasks."""
    u, v = names
    turned = [F.struct(F.col(a).alias(u), F.col(b).alias(v)) for a, b in (("u", "v"), ("v", "u"))]
    return pairs.select(F.inline(F.array(*turned)))


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge list (a, b): the smallest node
    it can reach. Nulls and loops are ignored."""
    use_checkpoints(edges.sparkSession)
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = edges.where("a <> b").select(high.alias("u"), low.alias("v")).distinct().checkpoint()
    before = None
    while (state := _state(now)) != before and state[0]:
        before = state
        now = _star(_star(_both_ways(now, "u", "v"), large=True), large=False).checkpoint()
    # every pair now has the smallest node of its component as v
    return _both_ways(now, "node", "other").select("node", F.least("node", "other").alias("component")).distinct()
