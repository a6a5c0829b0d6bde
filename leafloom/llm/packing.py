"""Filling containers of fixed capacity with documents of varying token lengths (problem 7).

Sum-of-squares online packing: each item goes to the fill level that leaves the sum of the squared counts of
partly filled containers smallest, tracked in an array of levels. Items are spread by hash over parts of at
most part_items items; each part is packed by one task. The containers that a round leaves less than FULL filled
are the items of the next, in as many parts as they need, until one part holds them all, the space left in them is below
WASTE of all, or nothing fits together any more: what a part could not combine is tried with TRIES other parts at most.
So later rounds see a small and falling number of units, and no task ever holds more than a part.

An item of more than the capacity is split into whole containers and one rest; no other item is split.

Defined results
* null, empty and blank texts have no or few tokens and are assigned like any other; no tokens take no space.
* repeated rows are items of their own; ties go to the fuller level; a capacity that is null or below 1 is left out.
* an empty table or no capacity gives an empty table; extra columns play no part; texts are tokenized whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.llm.joins import small_set
from leafloom.session import materialize

TOKENIZERS, TOKENIZER = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
PART_ITEMS, FULL, WASTE, TRIES = 20_000, 0.98, 0.002, 2

_encodings: dict[str, object] = {}


def pattern() -> str:
    """How the public tokenizers cut a text before merging."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoding(path: str, pat_str: str):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=pat_str, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(df: DataFrame, item: Column, text: Column, path: str | None = None, pat_str: str | None = None) -> DataFrame:
    """(item_id, tokens) of every row. path: the vocabulary file, which is shipped with the job; unset, that of the setting spark.leafloom.tokenizer."""
    spark = df.sparkSession
    path = path or spark.conf.get("spark.leafloom.tokenizer", f"{TOKENIZERS}/{TOKENIZER}")
    pat_str = pat_str or pattern()
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(SparkFiles.get(name), pat_str)
        for batch in batches:
            yield pd.DataFrame({"item_id": batch["item_id"].astype("Int64"), "tokens": [0 if t is None else len(enc.encode_ordinary(t)) for t in batch["t"]]})

    return df.select(item.cast("bigint").alias("item_id"), text.alias("t")).mapInPandas(emit, "item_id bigint, tokens bigint")


class Levels:
    """Open containers by fill level; counts[h] of them hold h tokens."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.cost = np.zeros(capacity + 1, np.int64)  # of one more at a level: 2 n + 1; none at 0 and when full
        self.cost[1:capacity] = 1
        self.gain = np.full(capacity + 1, np.iinfo(np.int64).max // 4, np.int64)  # of one less: 1 - 2 n, where there is one
        self.gain[0] = 0
        self.open: dict[int, list[int]] = {}
        self.made = 0
        self.last: int | None = None

    def _set(self, level: int, change: int) -> None:
        if 0 < level < self.capacity:
            n = self.counts[level] = self.counts[level] + change
            self.cost[level] = 2 * n + 1
            self.gain[level] = 1 - 2 * n if n else np.iinfo(np.int64).max // 4

    def place(self, size: int) -> int:
        """The container that an item of at most the capacity goes to."""
        if size == 0 and self.last is not None:
            return self.last
        room = self.capacity - size + 1
        total = self.gain[:room] + self.cost[size : size + room]
        level = room - 1 - int(np.argmin(total[::-1]))
        if level:
            container = self.open[level].pop()
            self._set(level, -1)
        else:
            container, self.made = self.made, self.made + 1
        self._set(level + size, 1)
        if level + size < self.capacity:
            self.open.setdefault(level + size, []).append(container)
        self.last = container
        return container


def _round(items: DataFrame, prefix: str) -> DataFrame:
    """items(budget_id, capacity, part, unit, size, tries) with the container each unit goes to, its fill and in how many rounds it has stayed as it is."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("unit", kind="stable")
        levels = Levels(int(group["capacity"].iat[0]))
        places = np.fromiter((levels.place(int(s)) for s in group["size"]), np.int64, len(group))
        fill = np.bincount(places, weights=group["size"].to_numpy(float)).astype(np.int64)
        alone = np.bincount(places) == 1
        tries = np.where(alone[places], group["tries"].to_numpy() + 1, 0)
        names = f"{prefix}{group['part'].iat[0]}-"
        return pd.DataFrame({"budget_id": group["budget_id"], "capacity": group["capacity"], "unit": group["unit"], "size": group["size"], "container": [f"{names}{p}" for p in places], "fill": fill[places], "tries": tries})

    return items.groupBy("budget_id", "part").applyInPandas(pack, "budget_id bigint, capacity bigint, unit string, size bigint, container string, fill bigint, tries int")


def _in_parts(units: DataFrame, counts: dict[int, int], part_items: int) -> DataFrame:
    """units with part: so many parts for each budget that hashing leaves none with more than part_items."""
    mean = max(1.0, part_items - 6 * part_items**0.5) if part_items > 1 else 1.0
    parts = {b: 1 if n <= part_items else int(-(-n // mean)) for b, n in counts.items()}
    many = F.element_at(F.create_map(*chain(*[(F.lit(b).cast("bigint"), F.lit(n)) for b, n in parts.items()])), F.col("budget_id"))
    return units.withColumn("part", F.pmod(F.xxhash64("unit", F.lit(11)), many))


def pack(sized: DataFrame, budgets: DataFrame, part_items: int = PART_ITEMS) -> DataFrame:
    """(budget_id, container_id, item_id, piece_no, tokens). sized: item_id, tokens; budgets: budget_id, capacity_tokens."""
    spark = sized.sparkSession
    sized = materialize(sized.withColumn("row_no", F.monotonically_increasing_id()), "token-counts")
    capacities = [(r.budget_id, r.capacity_tokens) for r in budgets.where("budget_id is not null and capacity_tokens >= 1").select("budget_id", "capacity_tokens").distinct().collect()]
    n_pieces = lambda c: F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(c)))
    sums = sized.agg(F.count("*").alias("n"), *[F.sum(n_pieces(c)).alias(f"n{k}") for k, (_, c) in enumerate(capacities)], F.sum("tokens").alias("tokens")).first()
    if not capacities or not sums.n:
        return spark.createDataFrame([], "budget_id bigint, container_id string, item_id bigint, piece_no bigint, tokens bigint")
    counts: dict[int, int] = {}
    for k, (b, _) in enumerate(capacities):
        counts[b] = counts.get(b, 0) + int(sums[f"n{k}"])
    each = sized.withColumn("b", F.explode(F.array(*[F.struct(F.lit(b).cast("bigint").alias("budget_id"), F.lit(c).cast("bigint").alias("capacity")) for b, c in capacities])))
    each = each.select("b.*", "item_id", "row_no", "tokens").withColumn("piece_no", F.explode(F.expr("sequence(0L, if(tokens = 0, 0L, (tokens - 1) div capacity))")))
    # a unit carries its item, so that the pieces need not be joined to their containers again
    unit = F.concat_ws(".", "row_no", "piece_no", F.coalesce(F.col("item_id").cast("string"), F.lit("")))
    now = each.select("budget_id", "capacity", unit.alias("unit"), F.least(F.col("tokens") - F.col("piece_no") * F.col("capacity"), F.col("capacity")).alias("size"), F.lit(0).alias("tries"))
    first, moves, turn = None, None, 0
    while True:
        placed = materialize(_round(_in_parts(now, counts, part_items), f"{turn}-"), "packed")
        if first is None:
            first = placed.select("budget_id", "unit", "size", "container")
        else:
            step = placed.select("budget_id", F.col("unit").alias("moved"), F.col("container").alias("later"))
            if moves is None:
                moves = step.withColumnRenamed("moved", "container")
            else:
                moves = moves.join(small_set(step), (moves.budget_id == step.budget_id) & (moves.later == step.moved), "left").select(moves.budget_id, "container", F.coalesce(step.later, moves.later).alias("later"))
            moves = materialize(moves, "pack-moves")
        loose = placed.where((F.col("fill") < FULL * F.col("capacity")) & (F.col("tries") < TRIES))
        now = loose.groupBy("budget_id", "capacity", F.col("container").alias("unit")).agg(F.first("fill").alias("size"), F.min("tries").cast("int").alias("tries"))
        left = {r.budget_id: r for r in now.groupBy("budget_id").agg(F.count("*").alias("n"), F.sum(F.col("capacity") - F.col("size")).alias("room")).collect()}
        # a budget is done when one part held all its units, or little room is left in them
        open_ = [b for b, r in left.items() if r.n > 1 and counts[b] > part_items and r.room > WASTE * max(1, sums.tokens)]
        if not open_:
            break
        now, counts, turn = now.where(F.col("budget_id").isin(open_)), {b: left[b].n for b in open_}, turn + 1
    if moves is not None:
        first = first.join(small_set(moves), ["budget_id", "container"], "left").withColumn("container", F.coalesce("later", "container"))
    part = F.split("unit", r"\.")
    return first.select("budget_id", F.col("container").alias("container_id"), F.expr("try_cast(split_part(unit, '.', 3) as bigint)").alias("item_id"), F.get(part, F.lit(1)).cast("bigint").alias("piece_no"), F.col("size").alias("tokens"))
