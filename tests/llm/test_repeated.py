import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from leafloom.llm import repeated
from leafloom.session import read

SF = "/root/testdata/sf0.001"


def brute(rows):
    """rows: (source, doc, row, [lines])"""
    key = lambda x: re.sub(r"\d+", "0", " ".join(x.lower().split()))
    docs, where = defaultdict(set), defaultdict(set)
    for s, d, _, ls in rows:
        if s is not None:
            docs[s].add(d)
            for x in ls:
                if sum(c.isalpha() for c in x) >= 12:
                    where[s, key(x)].add(d)
    good = {k for k, v in where.items() if len(v) >= 5 and len(v) >= 0.1 * len(docs[k[0]])}
    return {(r, i) for s, d, r, ls in rows if s is not None for i, x in enumerate(ls) if sum(c.isalpha() for c in x) >= 12 and (s, key(x)) in good}


def test_whole_table(spark):
    df = read(spark, SF, "documents")
    rows = [(r.source, r.doc_id, r.doc_id, (r.text or "").split("\n")) for r in df.collect()]
    got = {(r.row_id, r.line_no) for r in repeated.found(df, F.col("source"), F.col("doc_id"), F.col("doc_id"), F.col("text")).collect()}
    assert got == brute(rows) and got


def test_small_cases(spark):
    long = "word and word again " * 20_000
    rows = [("s", i, f"Page {i}  of the Same Notice\nbody {i} is unlike any other body {'xyzabcdefg'[i]}\n" + (long if i < 5 else ""), "c") for i in range(9)]
    rows += [("s", 9, "page 77 of the same notice \nPAGE 3 of the same notice", "c"), ("s", 10, None, "c"), ("s", 11, "", "c"), (None, 12, "Page 1 of the Same Notice", "c"), ("t", 13, "Page 1 of the Same Notice", "c")]
    df = spark.createDataFrame(rows, "source string, doc_id long, text string, key string")
    args = F.col("source"), F.col("doc_id"), F.col("doc_id"), F.col("text")
    where = repeated.found(df, *args)
    got = {(r.row_id, r.line_no) for r in where.collect()}
    assert got == brute([(s, d, d, (t or "").split("\n")) for s, d, t, _ in rows])
    texts = {r.doc_id: (r.text, r.key) for r in repeated.remove(df, args[0], args[1], "text", repeated.tried_and_kept(df, *args)[1]).collect()}
    assert texts[9] == ("", "c") and texts[10] == (None, "c") and texts[11] == ("", "c") and texts[12][0] == "Page 1 of the Same Notice" and texts[7][0].startswith("body 7")
    assert repeated.found(df.where("false"), *args).count() == 0


def test_removed_are_the_found_lines(spark, monkeypatch):
    """The pass over the texts takes out what found() lists, with few and with many sources a task."""
    df = read(spark, SF, "documents")
    args = F.col("source"), F.col("doc_id"), F.col("doc_id"), F.col("text")
    gone = {(r.row_id, r.line_no) for r in repeated.found(df, *args).collect()}
    monkeypatch.setattr(repeated, "SOURCES_A_TASK", 1)
    left = {r.doc_id: r.text for r in repeated.remove(df, args[0], args[1], "text", repeated.tried_and_kept(df, *args)[1]).collect()}
    for r in df.collect():
        want = None if r.text is None else "\n".join(x for i, x in enumerate(r.text.split("\n")) if (r.doc_id, i) not in gone)
        assert left[r.doc_id] == want


def test_summary_bounds():
    rng = np.random.default_rng(1)
    stream = np.concatenate([rng.zipf(1.3, 20_000), rng.integers(10**6, 2 * 10**6, 20_000)])
    rng.shuffle(stream)
    true = Counter(stream.tolist())
    parts = []
    for chunk in np.split(stream, 8):
        s = repeated.Summary(100)
        for piece in np.array_split(chunk, 5):
            s.add(*np.unique(piece, return_counts=True))
        parts.append(s)
    merged = repeated.Summary(100)
    for s in parts:
        merged.add(s.keys, s.counts, s.error)
    held = dict(zip(merged.keys.tolist(), merged.counts.tolist()))
    assert len(held) <= 100 and merged.error <= len(stream) / 100
    assert all(held.get(k, 0) <= n <= held.get(k, 0) + merged.error for k, n in true.items())
