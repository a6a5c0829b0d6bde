"""Checks on page nodes: each gives finding rows (page_id, node_id, check, severity, value); the gate unions and rolls them up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.functions import box as B
from leafloom.operators import match

# Least and greatest heights by class, and the types whose loss counts.
CLASS_RANGES = {"body": (8, 60), "heading": (12, 70), "note": (6, 50), "formula": (8, 80)}
VALUABLE = ("equation", "image", "diagram_component", "table", "text_band", "text_fragment", "heading", "caption")
OBSTACLE_TYPES = ("equation", "image", "diagram_component", "table")
TEXT_TYPES = ("text_band", "text_fragment", "heading", "caption", "page_number", "header", "footer")


def finding(df: DataFrame, check: str, severity: Column | str, value: Column) -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return df.select("page_id", "node_id", F.lit(check).alias("check"), sev.alias("severity"), value.cast("double").alias("value"))


def bounds(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Boxes without extent or outside their page."""
    j = nodes.join(sizes, "page_id", "left")
    bad = F.when((F.col("w") <= 0) | (F.col("h") <= 0), 1).when((F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("w") > F.col("width")) | (F.col("y") + F.col("h") > F.col("height")), 2)
    return finding(j.withColumn("bad", bad).where("bad is not null"), "bbox_bounds", "error", F.col("bad"))


def class_ranges(nodes: DataFrame, ranges: dict[str, tuple[int, int]] = CLASS_RANGES) -> DataFrame:
    dim = nodes.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in ranges.items()], "class string, lo long, hi long")
    j = nodes.join(F.broadcast(dim), "class").where("h < lo or h > hi")
    return finding(j, "class_height", "review", F.col("h"))


def line_breaks(nodes: DataFrame) -> DataFrame:
    """Text fields with a line end, real or spelled out; in a formula only for review."""
    has = lambda c: F.col(f"{c}_breaks") if f"{c}_breaks" in nodes.columns else broken(F.col(c))
    return finding(nodes.where(has("text") | has("latex")), "line_break_field", F.when(has("text"), "error").otherwise("review"), F.lit(1))


def broken(c: Column) -> Column:
    """Whether a text holds a line end, real or spelled out."""
    return F.coalesce(c.contains("\n") | c.contains("\\n"), F.lit(False))


def covered_text(nodes: DataFrame, obstacles: DataFrame, relations: DataFrame, least: float = 0.05) -> DataFrame:
    """Text that an obstacle of its page covers, unless one of the two names the other. relations: (node_id, target)."""
    t = nodes.where(F.col("type").isin(*TEXT_TYPES)).select("page_id", "node_id", "b")
    o = obstacles.select("page_id", F.col("node_id").alias("obstacle"), F.col("b").alias("o"))
    hit = match.candidates(t, o, ["page_id"], B.intersects(F.col("b"), F.col("o"))).withColumn("part", F.round(B.fraction(F.col("b"), F.col("o")), 4)).where(F.col("part") >= least)
    named = hit.join(relations.select("node_id", F.col("target").alias("obstacle")), ["node_id", "obstacle"], "left_anti")
    return finding(named, "mask_intersection", "review", F.col("part"))


def duplicates(nodes: DataFrame, least: float = 0.98, tile: int = 200) -> DataFrame:
    """Text and obstacle nodes of one type with nearly the same box. Such boxes begin in the same or neighbouring tiles, so the pairs of a page with very many nodes are not all tried."""
    nodes = nodes.where(F.col("type").isin(*TEXT_TYPES, *OBSTACLE_TYPES))
    # with an IoU of at least `least` the corners are less apart than 1 - least of the sides
    near = F.floor(F.col("y") / tile)
    a = nodes.withColumn("tile", near).select("page_id", "type", "tile", "node_id", "node_no", "b")
    reach = F.ceil((1 - least) * F.col("h") / least).cast("bigint")
    b = nodes.withColumn("tile", F.explode(F.sequence(F.floor((F.col("y") - reach) / tile), F.floor((F.col("y") + reach) / tile)))).select("page_id", "type", "tile", F.col("node_no").alias("no_2"), F.col("b").alias("b_2"))
    hit = match.candidates(a, b, ["page_id", "type", "tile"], (F.col("node_no") < F.col("no_2")) & B.intersects(F.col("b"), F.col("b_2")))
    return finding(hit.withColumn("iou", B.iou(F.col("b"), F.col("b_2"))).where(F.col("iou") >= least), "duplicate_bbox", "review", F.round("iou", 4))


def difference(baseline: DataFrame, candidate: DataFrame, tolerance: int = 2) -> DataFrame:
    """(node_id, status, type, moved): removed, added, changed or same; the last of equal ids counts."""
    last = lambda df: match.best(df, ["node_id"], F.desc("node_no")).select("node_id", "type", "class", "b")
    a, c = last(baseline).alias("a"), last(candidate).alias("c")
    j = a.join(c, F.col("a.node_id") == F.col("c.node_id"), "full_outer")
    moved = B.delta(F.col("a.b"), F.col("c.b"))
    status = F.when(F.col("c.node_id").isNull(), "removed").when(F.col("a.node_id").isNull(), "added").when((F.col("a.type") != F.col("c.type")) | (F.col("a.class") != F.col("c.class")) | (moved > tolerance), "changed").otherwise("same")
    return j.select(F.coalesce("a.node_id", "c.node_id").alias("node_id"), status.alias("status"), F.coalesce("a.type", "c.type").alias("type"), moved.alias("moved"))


def regressions(diff: DataFrame) -> DataFrame:
    lost = diff.where(F.col("status") == "removed").where(F.col("type").isin(*VALUABLE))
    return lost.select(F.regexp_extract("node_id", r"^(\w+-p\d+)", 1).alias("page_id"), "node_id", F.lit("regression").alias("check"), F.lit("error").alias("severity"), F.lit(1.0).alias("value"))


def gate(findings: list[DataFrame]) -> DataFrame:
    """Counts by check and severity with totals, and the overall status: fail, review or pass."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), findings)
    return every.rollup("check", "severity").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "error").alias("errors")).select(
        F.coalesce("check", F.lit("all")).alias("check"), F.coalesce("severity", F.lit("all")).alias("severity"), "n", F.when(F.col("errors") > 0, "fail").when(F.col("n") > 0, "review").otherwise("pass").alias("status")
    )
