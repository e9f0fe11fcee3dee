"""Distributed connected components by alternating large-star and small-star steps.

Each round is two aggregations and two joins over the edge list, and the edge list never grows.
Rounds are written to the shared scratch folder, so lineage stays one round deep and a lost
executor repeats one round at most.  Nothing but two numbers per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.shared import dropped, written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of comparable ids -> ``(node, component)``, component = smallest id reached.

    Only nodes that are not the smallest of their component are returned, each once.  Self-loops,
    repeats and nulls in the input are ignored.  An empty input gives an empty result.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "cc",
    )
    before = None
    for _ in range(max_rounds):
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if state[0] == 0 or state == before:
            break
        before = state
        # large star: every neighbour above u moves to u's least neighbour (or u)
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("u", "m").alias("m"))
        large = (
            both.join(least, F.col("u") == F.col("mu"))
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .distinct()
        )
        large = written(large, "cc")
        # small star: the lower neighbours of u, and u, move to the least of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "mh")
        moved = large.join(low, F.col("hi") == F.col("mh")).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = written(moved.unionByName(low.select(F.col("mh").alias("hi"), F.col("m").alias("lo"))).distinct(), "cc")
        dropped(large)
        dropped(now)
        now = after
    else:
        raise RuntimeError(f"components still move after {max_rounds} rounds")
    nodes = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes
