"""Evaluation texts leaking into training text (problem 8).

1. Every document is scanned once for the items' word n-grams, against a Bloom filter of bounded size; documents with
   any hit are written with their words, and their hits are joined to the items' n-grams.
2. The hits are counted over all documents; in each run of min_words words of a passage the rarest n-grams become
   seeds. A run of that length holds a seed by construction, so no exact leak is lost by leaving common n-grams out.
3. Documents are joined to items by their seeds; Smith-Waterman alignment over words, around the seeds,
   scores paraphrased and edited copies. What is aligned well enough is checked for its longest common run of words.
4. For the report, edited copies are also looked for by all 3-grams, two of them or as many as a tenth of the passage's
   words about one diagonal, in a scan of their own.

Equal passages count as one until the end. The items are a stated query set: for step 4 they are taken in blocks of
BLOCK_WORDS words, so that what goes to the tasks is bounded.

Words are runs of letters and digits of the canonical text in lower case.

Defined results
* null or empty texts and passages leak nothing; passages of fewer than min_words words can't be found.
* a passage under two ids is reported for both; repeated rows give one row per (document, item).
* an empty table gives an empty table; extra columns play no part; texts of any length are scanned whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.llm import bloom
from leafloom.llm.canon import canonical
from leafloom.llm.joins import with_one
from leafloom.session import materialize

MIN_WORDS, GRAM, BLOCK_WORDS = 13, 8, 4_000_000
EDITED_GRAM, BAND, EDITED_SHARE, EVIDENCE = 3, 8, 0.5, 0.1
MATCH, MISMATCH, GAP = 2, -1, -1
WORDS = re.compile(r"[^\W_]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return WORDS.findall(canonical(text).lower())


class WordHash(dict):
    """64-bit hashes of words, the same in every process; a memo that starts anew when it has grown."""

    def __missing__(self, word: str) -> int:
        value = bloom.word_hash(word)
        if len(self) > 500_000:
            self.clear()
        self[word] = value
        return value

    def of(self, ws: list[str]) -> np.ndarray:
        return np.fromiter((self[w] for w in ws), np.uint64, len(ws))


def grams(hashes: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hashes of the runs of n words, by start."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.int64)
    out = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ (out >> np.uint64(29))) * _FACTOR + hashes[k : k + size]
        out = (out ^ (out >> np.uint64(32))) * _FACTOR
    return out.view(np.int64)


def gram_rows(passages: DataFrame, n: int = GRAM) -> DataFrame:
    """(pid, place, gram) of passages(pid, hashes)."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pid, hashes in zip(batch["pid"], batch["hashes"]):
                own = grams(np.asarray(hashes, np.int64).view(np.uint64), n)
                yield pd.DataFrame({"pid": pid, "place": np.arange(len(own)), "gram": own})

    return passages.select("pid", "hashes").mapInPandas(emit, "pid string, place bigint, gram bigint")


def scan(df: DataFrame, row: Column, text: Column, wanted: bloom.Bloom, n: int = GRAM) -> DataFrame:
    """(row_id, words, starts, grams) of the rows with any n-gram that the filter lets pass."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHash()
        for batch in batches:
            rows = []
            lists = [words(t) for t in batch["t"]]
            sizes = [len(x) for x in lists]
            every = grams(np.fromiter((memo[w] for x in lists for w in x), np.uint64, sum(sizes)), n)
            at = wanted.passing(every)
            ends = np.cumsum(sizes)
            doc = np.searchsorted(ends, at, side="right")
            inside = at + n <= ends[np.minimum(doc, len(ends) - 1)]  # a run of words across two rows is none
            at, doc = at[inside], doc[inside]
            for d in np.unique(doc):
                own = at[doc == d]
                rows.append((batch["row_id"].iat[d], lists[d], (own - (ends[d] - sizes[d])).tolist(), every[own].tolist()))
            if rows:
                yield pd.DataFrame(rows, columns=["row_id", "words", "starts", "grams"])

    source = df.select(row.cast("bigint").alias("row_id"), text.alias("t")).where("row_id is not null and t is not null")
    return source.mapInPandas(emit, "row_id bigint, words array<string>, starts array<bigint>, grams array<bigint>")


def choose(own: list[int], counts: dict[int, int], min_words: int = MIN_WORDS, n: int = GRAM) -> set[int]:
    """Of a passage's n-grams the rarest in each run of min_words words, ties by hash."""
    width = min_words - n + 1
    return {min(own[k : k + width], key=lambda g: (counts[g], g)) for k in range(len(own) - width + 1)}


def seeds(counted: DataFrame, min_words: int = MIN_WORDS, n: int = GRAM) -> DataFrame:
    """(pid, gram): the seeds of counted(pid, place, gram, n), one passage a group."""

    def of_passage(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        chosen = choose(group["gram"].tolist(), dict(zip(group["gram"].tolist(), group["n"].tolist())), min_words, n)
        return pd.DataFrame({"pid": group["pid"].iat[0], "gram": sorted(chosen)})

    return counted.groupBy("pid").applyInPandas(of_passage, "pid string, gram bigint")


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    """The longest run of words that a and b have in common."""
    best, previous = 0, np.zeros(len(b) + 1, np.int32)
    for x in a:
        now = np.zeros(len(b) + 1, np.int32)
        same = b == x
        now[1:][same] = previous[:-1][same] + 1
        best = max(best, int(now.max(initial=0)))
        previous = now
    return best


def align(a: np.ndarray, b: np.ndarray) -> int:
    """The Smith-Waterman score of the best local alignment of two word sequences, gaps linear."""
    best, previous = 0, np.zeros(len(b) + 1, np.int64)
    ramp = np.arange(len(b) + 1) * -GAP
    for x in a:
        step = np.where(b == x, MATCH, MISMATCH)
        now = np.zeros(len(b) + 1, np.int64)
        now[1:] = np.maximum(previous[:-1] + step, previous[1:] + GAP)
        now = np.maximum(now, 0)
        now = np.maximum.accumulate(now + ramp) - ramp  # gaps along b
        best = max(best, int(now.max(initial=0)))
        previous = now
    return best


def _windows(starts: list[int], reach: int, end: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted(starts):
        a, b = max(0, s - reach), min(end, s + reach)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def compare(tried: DataFrame, min_score: int = MATCH * MIN_WORDS) -> DataFrame:
    """(row_id, pid, run, score, share) of tried(row_id, pid, starts, words, hashes) aligned with at least min_score; share is the score against that of the whole passage."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHash()
        for batch in batches:
            rows = []
            for row, pid, starts, ws, hashes in zip(batch["row_id"], batch["pid"], batch["starts"], batch["words"], batch["hashes"]):
                passage, text = np.asarray(hashes, np.int64).view(np.uint64), memo.of(list(ws))
                run = score = 0
                for a, b in _windows([int(s) for s in starts], 2 * len(passage), len(text)):
                    own = align(passage, text[a:b])
                    score = max(score, own)
                    if own >= min_score:
                        run = max(run, longest_run(passage, text[a:b]))
                if score >= min_score:
                    rows.append((row, pid, run, score, score / (MATCH * len(passage))))
            if rows:
                yield pd.DataFrame(rows, columns=["row_id", "pid", "run", "score", "share"])

    return tried.select("row_id", "pid", "starts", "words", "hashes").mapInPandas(emit, "row_id bigint, pid string, run bigint, score bigint, share double")


def edited(df: DataFrame, row: Column, text: Column, passages: dict[str, np.ndarray], least: float = EDITED_SHARE, n: int = EDITED_GRAM) -> DataFrame:
    """(row_id, pid, run, score, share) of the pairs of at least that share that have n-grams about one diagonal: two, or as many as EVIDENCE of the passage's words, however short the intact runs are."""
    names = sorted(passages)
    each = [grams(passages[i], n) for i in names]
    every = np.concatenate(each) if each else np.empty(0, np.int64)
    order = np.argsort(every, kind="stable")
    wanted = every[order]
    owner = np.repeat(np.arange(len(names)), [len(g) for g in each])[order]
    place = np.concatenate([np.arange(len(g)) for g in each])[order] if each else np.empty(0, np.int64)
    sets = [np.unique(passages[i]) for i in names]
    sizes = np.array([len(passages[i]) for i in names], np.int64)
    need, spread = np.maximum(2, (EVIDENCE * sizes).astype(np.int64)), np.maximum(BAND, sizes // 5)

    def pairs(hashes: np.ndarray) -> Iterator[tuple[str, int, int, float]]:
        own = grams(hashes, n)
        lo, hi = np.searchsorted(wanted, own, "left"), np.searchsorted(wanted, own, "right")
        at = np.flatnonzero(hi > lo)
        size = (hi - lo)[at]
        if size.sum() < 2:
            return
        k = np.repeat(lo[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        start = np.repeat(at, size)
        item, diagonal = owner[k], start - place[k]
        by = np.lexsort((diagonal, item))
        item, diagonal, start = item[by], diagonal[by], start[by]
        last = np.arange(len(item)) + need[item] - 1  # of as many hits in order of their diagonals
        inside = last < len(item)
        last = np.where(inside, last, 0)
        good = inside & (item[last] == item) & (diagonal[last] - diagonal <= spread[item])
        item, start = item[good], start[good]
        for i in np.unique(item).tolist():
            passage = passages[names[i]]
            size_p, best = len(passage), (0, 0)
            for a, b in _windows(start[item == i].tolist(), 2 * size_p, len(hashes)):
                window = hashes[a:b]
                # a share s takes s x size matches or more, and an alignment of a share over 0 spans at most 3 x size words
                in_passage = np.concatenate([[0], np.cumsum(np.isin(window, sets[i]))])
                span = min(len(window), 3 * size_p)
                if (in_passage[span:] - in_passage[: len(in_passage) - span]).max() < least * size_p:
                    continue
                score = align(passage, window)
                if score >= least * MATCH * size_p:
                    best = max(best, (score, longest_run(passage, window)))
            if best[0]:
                yield names[i], best[1], best[0], best[0] / (MATCH * size_p)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHash()
        for batch in batches:
            rows = [(i, *found) for i, t in zip(batch["row_id"], batch["t"]) for found in pairs(memo.of(words(t)))]
            if rows:
                yield pd.DataFrame(rows, columns=["row_id", "pid", "run", "score", "share"])

    source = df.select(row.cast("bigint").alias("row_id"), text.alias("t")).where("row_id is not null and t is not null")
    return source.mapInPandas(emit, "row_id bigint, pid string, run bigint, score bigint, share double")


def known_passages(items: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(pid, hashes) of the different passages of at least min_words words, and (pid, item_id) of the items that have them."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHash()
        for batch in batches:
            rows = [(i, memo.of(ws).view(np.int64).tolist()) for i, p in zip(batch["item_id"], batch["passage"]) if len(ws := words(p)) >= min_words]
            if rows:
                yield pd.DataFrame(rows, columns=["item_id", "hashes"])

    source = items.select(F.col("item_id").cast("bigint").alias("item_id"), "passage").where("item_id is not null and passage is not null").distinct()
    each = materialize(source.mapInPandas(emit, "item_id bigint, hashes array<bigint>").withColumn("pid", F.md5(F.array_join(F.col("hashes").cast("array<string>"), " "))), "leak-passages")
    return each.groupBy("pid").agg(F.first("hashes").alias("hashes")), each.select("pid", "item_id").distinct()


def leaks(df: DataFrame, row: Column, text: Column, items: DataFrame, min_words: int = MIN_WORDS, n: int = GRAM, block_words: int = BLOCK_WORDS, edits: bool = False) -> DataFrame:
    """(row_id, item_id, run, score, share) of all that share a seed and are aligned. items: item_id, passage. edits: also edited copies without a seed."""
    passages, members = known_passages(items, min_words)
    rows = materialize(gram_rows(passages, n), "leak-grams")
    hits = materialize(scan(df, row, text, bloom.build(rows, "gram"), n).withColumn("hit", F.monotonically_increasing_id()), "leak-hits")
    each = hits.select("hit", F.explode(F.arrays_zip("starts", "grams")).alias("x")).select("hit", F.col("x.starts").alias("start"), F.col("x.grams").alias("gram"))
    counts = each.select("hit", "gram").distinct().groupBy("gram").agg(F.count("*").alias("n"))
    chosen = materialize(seeds(with_one(rows, counts, "gram").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint"))), min_words, n), "leak-seeds")
    tried = with_one(each, chosen, "gram", "inner").groupBy("hit", "pid").agg(F.collect_list("start").alias("starts"))
    found = compare(tried.join(hits.select("hit", "row_id", "words"), "hit").join(passages, "pid"), MATCH * min_words)
    if edits:
        n_blocks = max(1, -(-(passages.agg(F.sum(F.size("hashes"))).first()[0] or 0) // block_words))
        for k in range(n_blocks):
            block = passages.where(F.pmod(F.xxhash64("pid"), F.lit(n_blocks)) == k)
            found = found.unionByName(edited(df, row, text, {r.pid: np.asarray(r.hashes, np.int64).view(np.uint64) for r in block.toLocalIterator()}))
    best = found.groupBy("row_id", "pid").agg(F.max("run").alias("run"), F.max("score").alias("score"), F.max("share").alias("share"))
    return best.join(members, "pid").groupBy("row_id", "item_id").agg(F.max("run").alias("run"), F.max("score").alias("score"), F.max("share").alias("share"))
