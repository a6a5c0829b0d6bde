import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafloom.llm import bloom, leaks
from leafloom.session import read

SF = "/root/testdata/sf0.001"


def brute(docs, items, n=13):
    runs = {i: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for i, p in items if p is not None and i is not None for w in [leaks.words(p)]}
    out = set()
    for d, t in docs:
        w = leaks.words(t or "")
        own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        out |= {(d, i) for i, r in runs.items() if own & r}
    return out


def test_whole_table(spark):
    docs, items = read(spark, SF, "documents"), read(spark, SF, "test_items")
    got = {(r.row_id, r.item_id) for r in leaks.leaks(docs, F.col("doc_id"), F.col("text"), items).where("run >= 13").collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.passage) for r in items.collect()]) and got


def test_small_cases(spark):
    p = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    docs = [(1, "x " + p), (1, "x " + p), (2, p.upper().replace(" ", ",\n")), (3, p.replace("seven", "7")), (4, None), (5, ""), (6, "y " * 100_000 + p), (7, p.replace("one ", "").replace(" fifteen", "")), (8, p.replace("one two ", "").replace(" fifteen", "")), (9, "ｏｎｅ " + p[4:])]
    items = [(10, p), (11, p), (12, "too short a passage"), (13, None), (14, "")]
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, t string, words string")
    i = spark.createDataFrame(items, "item_id long, passage string")
    for edits, block_words in ((False, 1), (True, 4_000_000), (True, 20)):
        found = leaks.leaks(d, F.col("doc_id"), F.col("t"), i, edits=edits, block_words=block_words)
        assert {(r.row_id, r.item_id) for r in found.where("run >= 13").collect()} == brute(docs, items)
        assert found.count() == found.select("row_id", "item_id").distinct().count()
    assert leaks.leaks(d.where("false"), F.col("doc_id"), F.col("t"), i).count() == 0
    assert leaks.leaks(d, F.col("doc_id"), F.col("t"), i.where("false")).count() == 0


def test_edited_copies(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghiklmnoprstuvz", k=6))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(30)]
    filling = lambda: " ".join(word() for _ in range(60))
    docs = []
    for every in (8, 5, 4):
        for k, p in items:
            docs.append((every * 100 + k, f"{filling()} {' '.join(word() if j % every == every - 1 else w for j, w in enumerate(p.split()))} {filling()}"))
    for k, p in items:  # random changes, insertions and deletions of 15 % of the words
        edits = [rng.choice([word(), w + " " + word(), ""]) if rng.random() < 0.15 else w for w in p.split()]
        docs.append((k, f"{filling()} {' '.join(edits)} {filling()}"))
    d = spark.createDataFrame(docs, "doc_id long, t string")
    i = spark.createDataFrame(items, "item_id long, passage string")
    args = d, F.col("doc_id"), F.col("t"), i
    got = {(r.row_id, r.item_id) for r in leaks.leaks(*args, edits=True).where("share >= 0.5").collect()}
    hashes = leaks.WordHash()
    of = {k: hashes.of(leaks.words(p)) for k, p in items}
    want = {(r, k) for r, t in docs for k in [r % 100] if leaks.align(of[k], hashes.of(leaks.words(t))) >= 40}
    print("edited copies", len(want), "found", len(got & want), "by exact seeds", leaks.leaks(*args).where("share >= 0.5").count())
    assert len(want) >= 110 and got == want


@pytest.mark.parametrize("share,recall", [(0.1, 1.0), (0.2, 0.97), (0.3, 0.5)])
def test_recall_of_substituted_words(spark, share, recall):
    """At 30 % the alignment itself falls to about half of a whole passage's score, so only those over it count."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghiklmnoprstuvz", k=6))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(60)]
    docs = []
    for k, p in items:
        ws = p.split()
        for at in rng.sample(range(40), int(share * 40)):
            ws[at] = word()
        docs.append((k, f"{' '.join(word() for _ in range(50))} {' '.join(ws)} {word()}"))
    found = leaks.leaks(spark.createDataFrame(docs, "doc_id long, t string"), F.col("doc_id"), F.col("t"), spark.createDataFrame(items, "item_id long, passage string"), edits=True)
    got = {(r.row_id, r.item_id) for r in found.where("share >= 0.5").collect()}
    print("substituted", share, len(got), "of", len(items))
    assert all(a == b for a, b in got) and len(got) >= recall * len(items)


def test_filter_lets_no_gram_slip(spark):
    rows = spark.range(3000).select(F.xxhash64("id").alias("gram"))
    held = bloom.build(rows, "gram")
    own = np.array([r.gram for r in rows.collect()], np.int64)
    other = np.array([r.g for r in spark.range(3000, 60_000).select(F.xxhash64("id").alias("g")).collect()], np.int64)
    assert len(held.passing(own)) == 3000 and len(held.passing(other)) < 57
    words = bloom.build(spark.createDataFrame([("lens",), ("ěž",), (None,)], "w string"), "w", words=True)
    assert "lens" in words and "ěž" in words and "coil" not in words


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    run = best = 0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
            best = max(best, h[i + 1][j + 1])
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            run = max(run, k)
    assert leaks.align(np.array(a), np.array(b)) == best and leaks.longest_run(np.array(a), np.array(b)) == run
