"""Joins of many rows with one row a key, where one key may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS, PARTS = 200_000, 16


def small_set(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast where its counted rows are within the bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_one(many: DataFrame, one: DataFrame, on: str | list[str], how: str = "left", rows: int = BROADCAST_ROWS, parts: int = PARTS) -> DataFrame:
    """many joined with one, which has a row a key: broadcast within the bound, else each key's rows are spread over parts tasks."""
    if one.limit(rows + 1).count() <= rows:
        return many.join(F.broadcast(one), on, how)
    keys = [on] if isinstance(on, str) else on
    spread = many.withColumn("_part", F.pmod(F.xxhash64(*many.columns), F.lit(parts)).cast("int"))
    return spread.join(one.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), [*keys, "_part"], how).drop("_part")
