"""Trees as adjacency rows (node, parent) of any depth; nothing of a tree comes to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.session import materialize


def paths(nodes: DataFrame, node: str, parent: str, keys: list[str] | None = None) -> DataFrame:
    """nodes with path (array from the root) and depth, by pointer doubling: each join doubles the depth that is reached.

    A node in a cycle or under a missing parent has no path and is left out: once a round completes no path, none will be.
    """
    keys = keys or []
    columns = nodes.columns
    state = nodes.withColumn("_top", F.col(parent)).withColumn("path", F.array(node))
    state = materialize(state, "tree-paths")
    n_done = state.where("_top is null").count()
    while not state.where("_top is not null").isEmpty():
        up = state.select(*[F.col(k).alias(f"_{k}_up") for k in keys], F.col(node).alias("_up"), F.col("_top").alias("_next"), F.col("path").alias("_path"))
        on = F.col("_top") == F.col("_up")
        for k in keys:
            on = on & (F.col(k) == F.col(f"_{k}_up"))
        climbed = state.where("_top is not null").join(up, on).select(*columns, F.col("_next").alias("_top"), F.concat("_path", "path").alias("path"))
        state = materialize(state.where("_top is null").unionByName(climbed), "tree-paths")
        was, n_done = n_done, state.where("_top is null").count()
        if n_done == was:
            break
    return state.where("_top is null").drop("_top").withColumn("depth", F.size("path") - 1)


def ancestors(pathed: DataFrame, node: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, node, ancestor, distance) with each node its own ancestor at 0."""
    each = pathed.select(*(keys or []), node, F.col("depth"), F.posexplode("path").alias("_at", "ancestor"))
    return each.select(*(keys or []), node, "ancestor", (F.col("depth") - F.col("_at")).alias("distance"))


def subtree(pathed: DataFrame, node: str, keys: list[str], *aggs: Column) -> DataFrame:
    """Aggregates over each node's whole subtree, itself included."""
    each = pathed.withColumn("_root", F.explode("path"))
    return each.groupBy(*keys, F.col("_root").alias(node)).agg(*aggs)


def siblings(df: DataFrame, keys: list[str], parent: str, order: str, has: Column, *values: str) -> DataFrame:
    """values with their difference to those of the previous sibling that has them; the first is taken from 0."""
    w = Window.partitionBy(*keys, parent).orderBy(order)
    out = df.where(has)
    for v in values:
        out = out.withColumn(f"d{v}", F.col(v) - F.coalesce(F.lag(v).over(w), F.lit(0)))
    return out
