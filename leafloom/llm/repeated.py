"""Lines repeated across one source's documents (problem 2).

1. Each task keeps one mergeable heavy-hitter summary (Misra-Gries) per source of the hashed lines it sees, with
   the error it may have made beside it. Its capacity follows the lines per document, so that the error stays
   below half of the wanted share. Sums of the summaries, plus the summed errors, are upper bounds of the true counts:
   no line that is frequent enough can be missing among the candidates.
2. A second pass counts the candidates exactly, each once a document.
3. The confirmed lines are joined back as a broadcast set where its counted rows are few, else by a shuffle. They are
   removed in one pass over the texts with the set of each source, broadcast likewise, else its texts in several parts.

Lines are the same when they differ only in case, in outer or repeated spaces or in the digits of a number.

Defined results
* rows with a null source or group count for no source and lose no line; null and empty texts stay as they are.
* a line twice in a document counts once; a row delivered twice counts once, as its document key is the same.
* an empty table gives an empty table; extra columns stay; ties need no order, as every line over the bounds is taken.
* texts and lines of any length are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.llm.joins import small_set, with_one
from leafloom.session import materialize

MIN_LETTERS, MIN_DOCUMENTS, MIN_SHARE = 12, 5, 0.10
SOURCES_A_TASK = 2_000


def line_key(line: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.lower(line), r"[\s\p{Z}]+", " "))
    return F.regexp_replace(spaced, r"\p{Nd}+", "0")


def has_letters(line: Column, n: int = MIN_LETTERS) -> Column:
    return F.length(F.regexp_replace(line, r"\P{L}+", "")) >= n


def lines(df: DataFrame, source: Column, doc: Column, row: Column, text: Column, split: bool = True) -> DataFrame:
    """(source, doc, row_id, line_no, hash, check) of the lines that may count; the two hashes are the line's 128-bit key."""
    base = df.select(source.alias("source"), doc.alias("doc"), row.alias("row_id"), text.alias("t")).where("source is not null and doc is not null and t is not null")
    each = base.select("source", "doc", "row_id", F.posexplode(F.split("t", "\n"))) if split else base.select("source", "doc", "row_id", F.lit(0).alias("pos"), F.col("t").alias("col"))
    keyed = each.where(F.length("col") >= MIN_LETTERS).where(has_letters(F.col("col"))).withColumn("key", line_key(F.col("col")))
    return keyed.select("source", "doc", "row_id", F.col("pos").cast("bigint").alias("line_no"), F.xxhash64("key").alias("hash"), F.xxhash64("key", F.lit(1)).alias("check"))


class Summary:
    """A Misra-Gries summary of hashes: at most capacity counters; each true count lies in [count, count + error]."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray, error: int = 0) -> None:
        """Adds exact counts, or the counters and the error of another summary."""
        self.keys, inverse = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        self.counts = np.bincount(inverse, weights=np.concatenate([self.counts, counts]), minlength=len(self.keys)).astype(np.int64)
        self.error += error
        if len(self.keys) > self.capacity:
            cut = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            self.error += cut
            kept = self.counts > cut
            self.keys, self.counts = self.keys[kept], self.counts[kept] - cut


def summaries(each: DataFrame, share: float = MIN_SHARE, least: int = 64) -> DataFrame:
    """(source, hash, n, error): of every task, its counters per source; the row with a null hash carries the error."""

    def written(x: tuple[str, Summary]) -> pd.DataFrame:
        name, s = x
        return pd.DataFrame({"source": name, "hash": pd.array([*s.keys, None], dtype="Int64"), "n": [*s.counts, 0], "error": [0] * len(s.keys) + [s.error]})

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Summary] = {}
        seen: dict[str, list[int]] = {}
        for batch in batches:
            code, names = pd.factorize(batch["source"])
            hashes = batch["hash"].to_numpy(np.int64)
            new_doc = np.ones(len(batch), bool)  # the lines of a document come together
            new_doc[1:] = batch["doc_hash"].to_numpy()[1:] != batch["doc_hash"].to_numpy()[:-1]
            order = np.argsort(code, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                name = names[code[part[0]]]
                so_far = seen.setdefault(name, [0, 0])
                so_far[0] += len(part)
                so_far[1] += int(new_doc[part].sum())
                summary = held.setdefault(name, Summary(least))
                # n / capacity bounds the error; this keeps it below half of share x documents
                summary.capacity = max(summary.capacity, int(2 * so_far[0] / (share * max(1, so_far[1]))) + 1)
                summary.add(*np.unique(hashes[part], return_counts=True))
            if len(held) > SOURCES_A_TASK:  # they are merged later
                yield from map(written, held.items())
                held, seen = {}, {}
        yield from map(written, held.items())

    return each.select("source", F.xxhash64("doc").alias("doc_hash"), "hash").mapInPandas(emit, "source string, hash bigint, n bigint, error bigint")


def confirmed(each: DataFrame, sizes: DataFrame, share: float = MIN_SHARE, least: int = MIN_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(occurrences of candidates, confirmed lines). sizes: source, n_docs of every source."""
    merged = materialize(summaries(each, share), "line-summaries")
    errors = merged.groupBy("source").agg(F.sum("error").alias("error"))
    upper = merged.where("hash is not null").groupBy("source", "hash").agg(F.sum("n").alias("n"))
    frequent = upper.join(errors, "source").join(sizes, "source").where(F.col("n") + F.col("error") >= F.greatest(F.lit(float(least)), share * F.col("n_docs")))
    candidates = materialize(frequent.select("source", "hash"), "line-candidates")
    tried = materialize(each.join(small_set(candidates), ["source", "hash"], "left_semi"), "line-occurrences")
    exact = tried.groupBy("source", "hash", "check", "doc").agg(F.lit(1).alias("one")).groupBy("source", "hash", "check").agg(F.count("*").alias("n"))
    kept = exact.join(sizes, "source").where(F.col("n") >= F.greatest(F.lit(float(least)), share * F.col("n_docs"))).select("source", "hash", "check", "n", "n_docs")
    return tried, materialize(kept, "line-confirmed")


def tried_and_kept(df: DataFrame, source: Column, doc: Column, row: Column, text: Column, split: bool = True) -> tuple[DataFrame, DataFrame]:
    """What confirmed() gives for a table of texts."""
    sizes = df.select(source.alias("source"), doc.alias("doc")).where("source is not null and doc is not null").distinct().groupBy("source").agg(F.count("*").alias("n_docs"))
    each = materialize(lines(df, source, doc, row, text, split), "lines")  # the texts are read once
    return confirmed(each, sizes)


def found(df: DataFrame, source: Column, doc: Column, row: Column, text: Column, split: bool = True) -> DataFrame:
    """(row_id, line_no) of every repeated line."""
    tried, kept = tried_and_kept(df, source, doc, row, text, split)
    return tried.join(small_set(kept.select("source", "hash", "check")), ["source", "hash", "check"], "left_semi").select("row_id", "line_no").distinct()


def remove(df: DataFrame, source: Column, doc: Column, text: str, kept: DataFrame, split: bool = True) -> DataFrame:
    """df with the confirmed lines of each text's source taken out; a text of nothing else becomes empty. One pass: the texts stay where they are while the set is within the bound of a broadcast."""
    sets = kept.groupBy(F.col("source").alias("_source")).agg(F.collect_set(F.struct("hash", "check")).alias("_gone"))
    marked = with_one(df.withColumn("_source", F.when(doc.isNotNull(), source)), sets, "_source")

    def stays(line: Column) -> Column:
        key = line_key(line)
        one = F.struct(F.xxhash64(key).alias("hash"), F.xxhash64(key, F.lit(1)).alias("check"))
        return (F.length(line) < MIN_LETTERS) | ~has_letters(line) | ~F.array_contains("_gone", one)

    rest = F.array_join(F.filter(F.split(text, "\n"), stays), "\n") if split else F.when(stays(F.col(text)), F.col(text)).otherwise("")
    return marked.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(rest)).select(*df.columns)
