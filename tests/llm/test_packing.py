from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafloom.llm import packing, plans
from leafloom.session import read

SF = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.lists(st.integers(0, 40), max_size=60))
def test_levels_against_brute_force(capacity, sizes):
    levels, fills = packing.Levels(capacity), []
    for s in (min(x, capacity) for x in sizes):
        before = list(fills)
        c = levels.place(s)
        if c == len(fills):
            fills.append(0)
        fills[c] += s
        assert fills[c] <= capacity
        if s:
            squares = lambda f: sum(n * n for h, n in zip(*np.unique(f, return_counts=True)) if 0 < h < capacity) if f else 0
            options = [squares([*before, s])] + [squares(before[:i] + [b + s] + before[i + 1 :]) for i, b in enumerate(before) if 0 < b and b + s <= capacity]
            assert squares(fills) == min(options)


def check(rows, sizes, budgets):
    fill, pieces = defaultdict(int), defaultdict(list)
    for r in rows:
        fill[r.budget_id, r.container_id] += r.tokens
        pieces[r.budget_id, r.item_id].append((r.piece_no, r.tokens))
    waste = {}
    for b, c in budgets:
        assert all(f <= c for (k, _), f in fill.items() if k == b)
        for item, n in sizes.items():
            got = sorted(pieces[b, item])
            assert sum(t for _, t in got) == n and len(got) == max(1, -(-n // c)) and [p for p, _ in got] == list(range(len(got)))
        waste[b] = 1 - sum(sizes.values()) / (c * sum(1 for k, _ in fill if k == b))
    return waste


@pytest.mark.parametrize("part_items", [20_000, 500])
def test_little_space_is_left(spark, part_items):
    rng = np.random.default_rng(4)
    sizes = {i: int(n) for i, n in enumerate(np.minimum(rng.lognormal(4.5, 1.2, 3000), 5000))} | {9000: 0, 9001: 100_000}
    df = spark.createDataFrame(list(sizes.items()), "item_id long, tokens long")
    budgets = [(1, 512), (2, 2048)]
    b = spark.createDataFrame([*budgets, (3, None), (4, 0)], "budget_id long, capacity_tokens long")
    waste = check(packing.pack(df, b, part_items).collect(), sizes, budgets)
    assert waste[1] < 0.02 and waste[2] < 0.02
    assert packing.pack(df.where("false"), b).count() == 0 and packing.pack(df, b.where("false")).count() == 0


def test_items_over_half_the_capacity(spark, monkeypatch):
    """Nothing fits together, so the rounds end soon, and no task holds more than a part."""
    turns, seen = [], []
    plain = packing._round

    def watched(items, prefix):
        turns.append(prefix)
        seen.append(items.groupBy("budget_id", "part").count().agg(F.max("count")).first()[0])
        return plain(items, prefix)

    monkeypatch.setattr(packing, "_round", watched)
    df = spark.range(100_000).select(F.col("id").alias("item_id"), F.lit(6).cast("bigint").alias("tokens"))
    out = packing.pack(df, spark.createDataFrame([(1, 10)], "budget_id long, capacity_tokens long"), 10_000)
    assert out.select("container_id").distinct().count() == out.count() == 100_000
    assert len(turns) <= 3 and max(seen) <= 10_000


def test_rounds_fall_off(spark, monkeypatch):
    turns = []
    plain = packing._round
    monkeypatch.setattr(packing, "_round", lambda items, prefix: turns.append(prefix) or plain(items, prefix))
    rng = np.random.default_rng(1)
    sizes = {i: int(n) for i, n in enumerate(rng.integers(1, 400, 6000))}
    df = spark.createDataFrame(list(sizes.items()), "item_id long, tokens long")
    waste = check(packing.pack(df, spark.createDataFrame([(1, 1000)], "budget_id long, capacity_tokens long"), 1000).collect(), sizes, [(1, 1000)])
    assert waste[1] < 0.03 and len(turns) <= 4


def test_tokens_of_whole_texts(spark):
    df = spark.createDataFrame([(1, "A word, another word.", "c"), (2, None, "c"), (3, "", "c"), (3, "A word, another word. " * 50_000, "c")], "id long, t string, tokens string")
    got = sorted((r.item_id, r.tokens) for r in packing.token_counts(df, F.col("id"), F.col("t")).collect())
    enc = packing.encoding(f"{packing.TOKENIZERS}/{packing.TOKENIZER}", packing.pattern())
    assert got == [(1, len(enc.encode_ordinary("A word, another word."))), (2, 0), (3, 0), (3, len(enc.encode_ordinary("A word, another word. " * 50_000)))]


def test_query(spark):
    enc = packing.encoding(f"{packing.TOKENIZERS}/{packing.TOKENIZER}", packing.pattern())
    sizes = {r.doc_id: len(enc.encode_ordinary(r.text or "")) for r in read(spark, SF, "documents").collect()}
    budgets = [(r.budget_id, r.capacity_tokens) for r in read(spark, SF, "token_budgets").collect()]
    rows = [r.asDict() for r in plans.p7_packed(spark, SF).collect()]
    check([type("R", (), {**r, "item_id": r["doc_id"]}) for r in rows], sizes, budgets)
