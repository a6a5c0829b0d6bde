"""Operators on ordered rows: islands, carried values, scopes, intervals. One shuffle on the keys; all steps share it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys: list[str], *order) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def _before(keys: list[str], *order) -> Window:
    return _w(keys, *order).rowsBetween(Window.unboundedPreceding, -1)


def _upto(keys: list[str], *order) -> Window:
    return _w(keys, *order).rowsBetween(Window.unboundedPreceding, 0)


def island_ids(df: DataFrame, keys: list[str], order: list, starts: Column, into: str) -> DataFrame:
    """Numbers the stretches that begin where starts holds."""
    return df.withColumn(into, F.sum(F.when(starts, 1).otherwise(0)).over(_upto(keys, *order)))


def bands(df: DataFrame, keys: list[str], position: str, active: Column, min_length: int, merge_gap: int) -> DataFrame:
    """(keys, start, stop): runs of active places at least min_length long, then merged over gaps of up to merge_gap."""
    on = df.where(active).select(*keys, F.col(position).alias("p"))
    run = on.withColumn("r", F.col("p") - F.row_number().over(_w(keys, "p")))
    runs = run.groupBy(*keys, "r").agg(F.min("p").alias("start"), (F.max("p") + 1).alias("stop")).where(F.col("stop") - F.col("start") >= min_length).drop("r")
    gap = F.col("start") - F.lag("stop").over(_w(keys, "start"))
    ided = runs.withColumn("gap", gap)
    merged = island_ids(ided, keys, ["start"], F.coalesce(F.col("gap") > merge_gap, F.lit(True)), "band")
    return merged.groupBy(*keys, "band").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def union_of_intervals(df: DataFrame, keys: list[str], lo: str, hi: str, slack: int = 0) -> DataFrame:
    """(keys, lo, hi): the closed intervals merged where they touch or are at most slack apart."""
    reach = df.withColumn("reach", F.max(hi).over(_before(keys, lo, hi)))
    ided = island_ids(reach, keys, [lo, hi], F.coalesce(F.col(lo) > F.col("reach") + slack, F.lit(True)), "part")
    return ided.groupBy(*keys, "part").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("part")


def gaps(frames: DataFrame, blocks: DataFrame, keys: list[str], lo: str, hi: str, least: int = 1, margin: int = 0) -> DataFrame:
    """(keys, lo, hi): what the blocks leave of each frame, blocks widened by margin; pieces shorter than least are left out.

    frames: keys, lo, hi, one row per key; blocks: keys, lo, hi.
    """
    inside = blocks.withColumnsRenamed({lo: "b_lo", hi: "b_hi"}).join(frames, keys)
    cut = inside.select(*keys, F.greatest(F.col("b_lo") - margin, F.col(lo)).alias("lo"), F.least(F.col("b_hi") + margin, F.col(hi)).alias("hi")).where("hi > lo")
    merged = union_of_intervals(cut, keys, "lo", "hi")
    ends = frames.select(*keys, F.col(lo).alias("at"), F.col(lo).alias("to")).unionByName(merged.select(*keys, F.col("lo").alias("at"), F.col("hi").alias("to"))).unionByName(frames.select(*keys, F.col(hi).alias("at"), F.col(hi).alias("to")))
    w = _w(keys, "at", "to")
    each = ends.withColumn("start", F.lag("to").over(w))
    return each.where(F.col("at") - F.col("start") >= least).select(*keys, F.col("start").alias(lo), F.col("at").alias(hi))


def carried(df: DataFrame, keys: list[str], order: list[str], value: Column, into: str, inclusive: bool = True) -> DataFrame:
    """The last value that is not null up to here."""
    w = _upto(keys, *order) if inclusive else _before(keys, *order)
    return df.withColumn(into, F.last(value, ignorenulls=True).over(w))


def scope_depth(df: DataFrame, keys: list[str], order: str, opens: Column, closes: Column, into: str = "depth") -> DataFrame:
    """The number of open scopes at each row; an opener and its closer stand at the depth inside."""
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    return df.withColumn("_step", step).withColumn(into, F.sum("_step").over(_upto(keys, order)) + F.when(F.col("_step") == -1, 1).otherwise(0)).drop("_step")


def scope_pairs(df: DataFrame, keys: list[str], order: str, opens: Column, closes: Column) -> DataFrame:
    """(keys, opened, closed, depth) of properly nested scopes: the k-th opener of a depth goes with the k-th closer of it."""
    marked = scope_depth(df.withColumn("_o", opens).withColumn("_c", closes), keys, order, F.col("_o"), F.col("_c")).where("_o or _c")
    turn = marked.withColumn("k", F.row_number().over(_w([*keys, "depth", "_o"], order)))
    a = turn.where("_o").select(*keys, "depth", "k", F.col(order).alias("opened"))
    b = turn.where("_c").select(*keys, "depth", "k", F.col(order).alias("closed"))
    return a.join(b, [*keys, "depth", "k"]).drop("k")


def malformed(df: DataFrame, keys: list[str], order: str, opens: Column, closes: Column) -> DataFrame:
    """The keys whose scopes do not nest: a closer without an opener, or scopes left open."""
    d = scope_depth(df, keys, order, opens, closes)
    return d.groupBy(*keys).agg(F.min("depth").alias("low"), F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).alias("rest")).where("low < 0 or rest <> 0").select(*keys)


def merged_to_count(runs: DataFrame, keys: list[str], lo: str, hi: str, wanted: str) -> DataFrame:
    """Runs merged over their smallest gaps, the first where equal, until wanted are left."""
    gap = F.col(lo) - F.lag(hi).over(_w(keys, lo))
    with_gap = runs.withColumn("gap", gap).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    ranked = with_gap.withColumn("turn", F.row_number().over(_w(keys, F.col("gap").asc_nulls_last(), lo)))
    starts = F.col("gap").isNull() | (F.col("turn") > F.col("n") - F.greatest(F.col(wanted), F.lit(1)))
    ided = island_ids(ranked, keys, [lo], starts, "part")
    return ided.groupBy(*keys, "part").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("part")


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The first value, in order, at which half of the weight is reached."""
    total = df.groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    run = total.withColumn("c", F.sum("w").over(_upto(keys, value))).withColumn("t", F.sum("w").over(Window.partitionBy(*keys)))
    return run.where("c >= t / 2.0").groupBy(*keys).agg(F.min(value).alias(value))


def upper_median(value: Column) -> Column:
    """The element at n div 2 of the sorted values."""
    sorted_values = F.sort_array(F.collect_list(value))
    return F.element_at(sorted_values, (F.size(sorted_values) / 2).cast("int") + 1)
