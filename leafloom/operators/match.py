"""Choosing one partner among many. Every range join goes with an equality on the page, so Catalyst hashes on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best(pairs: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row by order of each key."""
    return pairs.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_turn = 1").drop("_turn")


def candidates(left: DataFrame, right: DataFrame, keys: list[str], condition: Column, how: str = "inner") -> DataFrame:
    """A range join within equal keys; left's and right's other columns must differ in name."""
    r = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = condition
    for k in keys:
        on = (F.col(k) == F.col(f"_{k}")) & on
    return left.join(r, on, how).drop(*[f"_{k}" for k in keys])


def as_of(rows: DataFrame, marks: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """rows with the value of the last mark at or before them: one union and one running window, no range join."""
    extra = [c for c in rows.columns if c not in (*keys, at)]
    a = rows.withColumn("_mark", F.lit(1)).withColumn("_value", F.lit(None).cast(marks.schema[value].dataType))
    b = marks.select(*keys, at, F.col(value).alias("_value")).withColumn("_mark", F.lit(0))
    for c in extra:
        b = b.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
    w = Window.partitionBy(*keys).orderBy(at, "_mark").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b.select(a.columns)).withColumn(value, F.last("_value", ignorenulls=True).over(w))
    return both.where("_mark = 1").drop("_mark", "_value")


def tiled(df: DataFrame, b: Column, size: int, into: str = "tile") -> DataFrame:
    """One row for each tile that a box touches: the equality key of range joins on pages with very many nodes."""
    tiles = lambda lo, n: F.sequence(F.floor(lo / size), F.floor((lo + F.greatest(n, F.lit(1)) - 1) / size))
    return df.withColumn("_ty", F.explode(tiles(b["y"], b["h"]))).withColumn("_tx", F.explode(tiles(b["x"], b["w"]))).withColumn(into, F.struct("_tx", "_ty")).drop("_tx", "_ty")
