"""Noise in text from scanned pages (problem 6).

1. Words are counted over all texts, and over the different texts; halves of words broken at line ends are left out.
2. Rare words are linked to words at least RATIO times as frequent, by either count, that plausible glyph edits lead
   to; so a text copied under many ids cannot make its misreadings look like words.
3. One scan marks furniture (running heads, page numbers) and broken words, lists the words that have links or glyphs
   that no word holds, with their context, and counts which words, hashed to BUCKETS, stand within WINDOW words of each link target.
4. Skip-gram vectors with negative samples are learnt from these counts, which are all that its loss depends on: given
   the vectors of the contexts each word's own is a small problem of its own, so that any number of words is learnt in
   parallel; the gradients of the few context vectors add up over all words.
5. Each doubtful word is corrected in context: of its links the one whose vector explains its neighbours best, if that
   explains them better than leaving the word as it is.
6. Texts are repaired: furniture out, words joined, words corrected at their line, and numbers; lines flow into paragraphs
   whether or not there are other marks, all in canonical form.

Which words are doubtful, and which are link targets, tasks ask a Bloom filter of bounded size; joins then settle it.

Defined results
* null and empty texts have no defects and stay as they are; an empty table gives an empty table.
* a row delivered twice has its defects once; a null row id is left out; extra columns play no part.
* ties between corrections go to the more frequent word, then to the one first in order.
* texts and lines of any length are processed whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.llm import bloom
from leafloom.llm.bloom import Bloom
from leafloom.llm.canon import canonical
from leafloom.session import materialize

# What a scan makes of letters, noise to true.
GLYPHS = {"c": "e", "@": "a", "1": "l", "j": "i", "ri": "n", "0": "o", "f": "t", "5": "s", "cl": "d", "ii": "u", "rn": "m", "b": "h", "9": "g", "ć": "č", "ď": "d'", "ť": "t'", "vv": "w", "6": "b", "8": "b", "|": "l", "$": "s", "€": "e"}
EXTRA = {"f": ("t", "ř"), "b": ("h", "ß"), "c": ("e", "o"), "1": ("l", "i")}
LOST_ACCENTS = {"a": "ä", "e": "ě", "ü": "ů"}
RATIO, LEAST = 6.0, 3
WINDOW, BUCKETS = 2, 64
DIM, NEGATIVES, ROUNDS, STEPS, SEED = 16, 5, 3, 25, 7
LEAVE = -1.0
MIXED, MIXED_TRUE = "@0159", "aolsg"
PAGE_WIDTH = 110
FLUSH, FLUSH_TARGETS = 300_000, 20_000

TOKEN = re.compile(r"[\w@]+(?:-[\w@]+)*")
MARKS = "-¬­‐‑"
BREAK = re.compile(rf"([^\W\d_]|[@\w])[{MARKS}] ?$")
BROKEN = re.compile(rf"[\w@-]*[\w@][{MARKS}] ?\n\s*[\w@-]+")
LINE_MARK = re.compile(rf"[{MARKS}] ?\n").search
NUMBER = re.compile(r"(?<![\w.,@-])(?=[0-9lIOoS.,]*[0-9])(?=[0-9.,]*[lIOoS])[0-9lIOoS]+(?:[.,][0-9lIOoS]+)?(?![\w@-])")
DIGITS = str.maketrans("lIOoS", "11005")
PAGE_NUMBER = re.compile(r"^\W*\d{1,4}\W*$|^(?:page|p\.?|seite|s\.|strana|str\.)\s*\d{1,4}$", re.I)
ROMAN = re.compile(r"^(?=.)(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$", re.I)
NUMBERED_HEAD = re.compile(r"^\s*\d{1,4}\s{3,}\S.*$|^.*\S\s{3,}\d{1,4}\s*$")
SPACED_HEAD = re.compile(r"^\s*(?:\S )(?:\S | {2}){4,}\S?\s*$")


def _plain(line: str) -> str:
    return "".join(c for c in line.lower() if c.isalpha())


def furniture(lines: list[str], title: str | None, by_shape: bool) -> set[int]:
    """The running heads and page numbers set among the lines. by_shape: whether a bare head may be told by its looks alone."""
    filled = [i for i, x in enumerate(lines) if x and not x.isspace()]
    if len(filled) < 3:
        return set()
    out, heads = set(), set()
    for i in filled[1:-1]:
        x = lines[i]
        if len(x) <= 40 and (PAGE_NUMBER.match(s := x.strip()) or (1 < len(s) <= 12 and ROMAN.match(s))):
            out.add(i)
        elif "   " in x and (NUMBERED_HEAD.match(x) or SPACED_HEAD.match(x)):
            out.add(i)
            heads.add(_plain(x))
    head = _plain(title or "")
    initial = head[:1] if len(head) >= 8 else ""
    width = max((len(lines[i]) for i in filled if i not in out), default=0)
    for k in range(1, len(filled) - 1):
        i = filled[k]
        if i in out:
            continue
        x = lines[i].strip()
        shaped = by_shape and x[0].isupper() and x[-1].isalpha() and len(x) < 70
        titled = initial and x[-1] != "." and next((c for c in x if c.isalpha()), "").lower() == initial
        if not (shaped or titled or heads):
            continue
        plain = _plain(x) if titled or heads else ""
        titled = titled and plain.startswith(head) and len(plain) <= len(head) + 16
        if not (shaped or titled or plain in heads):
            continue
        follow = next((lines[j].strip() for j in filled[k + 1 :] if j not in out), "")
        before = next((lines[j].rstrip() for j in reversed(filled[:k]) if j not in out), "")
        goes_on = before[-1:] in MARKS or follow[:1].islower() or (before[-1:].islower() and len(plain) > len(head) + 2)
        if plain and plain in heads or titled and goes_on:
            out.add(i)
            continue
        words = x.split()
        if not (shaped and 2 <= len(words) <= 9) or any(c.isdigit() or c == "." for c in x):
            continue
        upper = x == x.upper()
        named = words[-1][0].isupper() and not any(w[-1] in ",;:" for w in words)
        short = len(x) + 1 + len(follow.split(" ")[0]) <= width
        if upper or (named and short and follow and (follow[0].islower() or follow[0].isdigit() or before[-1:] not in ".!?" or before[-1:] in MARKS)):
            out.add(i)
    return out


def breaks(lines: list[str], out: set[int]) -> list[tuple[int, int, str, str, str]]:
    """(line, next running line, mark, left part, right part) of words broken at a line end."""
    running = [i for i, x in enumerate(lines) if i not in out and x.strip()]
    found = []
    for i, j in zip(running, running[1:]):
        x = lines[i].rstrip("\r\t")
        if x[-2:].strip()[-1:] in MARKS and BREAK.search(x):
            stem = x.rstrip()[:-1]
            left = re.search(r"[\w@]+(?:-[\w@]+)*$", stem)
            right = re.match(r"\s*([\w@]+(?:-[\w@]+)*)", lines[j])
            if left and right and (right.group(1)[0].islower() or right.group(1)[0] in "@0159" or left.group().isupper()):
                found.append((i, j, x.rstrip()[-1], left.group(), right.group(1)))
    return found


class Member(dict):
    """Whether a filter lets words pass; a memo that starts anew when it has grown."""

    def __init__(self, held: Bloom):
        self.held = held

    def __missing__(self, word: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = word in self.held
        return value


class Chunks(dict):
    """What stands between spaces, to (its words in lower case, which are in doubt, whether a number in it is misread); a memo that starts anew when it has grown."""

    def __init__(self, doubt: Member):
        self.doubt = doubt

    def __missing__(self, chunk: str) -> tuple[list[str], list[bool], bool]:
        plain = canonical(chunk)
        own = TOKEN.findall(plain.lower())
        value = own, [not w.isdigit() and self.doubt[w] for w in own], NUMBER.search(plain) is not None
        if len(self) > 500_000:
            self.clear()
        self[chunk] = value
        return value


class Targets(dict):
    """The rows of link targets in a table of counts, -1 for other words."""

    def __init__(self, held: Bloom):
        self.held, self.words = held, []

    def __missing__(self, word: str) -> int:
        if not word or word not in self.held:
            self[word] = -1
            return -1
        self.words.append(word)
        self[word] = len(self.words) - 1
        return len(self.words) - 1

    def start_anew(self) -> None:
        self.clear()
        self.words = []


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, n, n_apart) over all texts(t): how often in all rows, and how often when equal texts count once. Chunks are counted first, so that each different one is read once a task."""

    def words_of(chunks: Counter, more: Counter) -> pd.DataFrame:
        apart: Counter = Counter()
        repeated: Counter = Counter()
        for chunk, n in chunks.items():
            again = more[chunk]
            for w in TOKEN.findall(canonical(chunk).lower()):
                apart[w] += n
                if again:
                    repeated[w] += again
        return pd.DataFrame({"word": list(apart), "n": [n + repeated[w] for w, n in apart.items()], "n_apart": list(apart.values())})

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunks: Counter = Counter()
        more: Counter = Counter()  # by further rows of the same text
        for batch in batches:
            for t, times in zip(batch["t"], batch["times"]):
                parts = (BROKEN.sub(" ", t) if LINE_MARK(t) else t).split()
                chunks.update(parts)
                if times > 1:
                    for chunk in parts:
                        more[chunk] += times - 1
            if len(chunks) > FLUSH:
                yield words_of(chunks, more)
                chunks, more = Counter(), Counter()
        if chunks:
            yield words_of(chunks, more)

    different = texts.select("t").where("t is not null").groupBy("t").agg(F.count("*").alias("times"))
    return different.mapInPandas(emit, "word string, n bigint, n_apart bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_apart").alias("n_apart"))


_EDITS = [(a, b) for a, bs in {**{k: (v,) for k, v in GLYPHS.items()}, **EXTRA}.items() for b in bs]


def repairs(word: str) -> set[str]:
    """What a word may have been: glyphs that no word holds are all set right, and up to two more edits are tried."""
    base = word
    if any(c.isalpha() for c in word):
        base = word.replace("@", "a").replace("0", "o").replace("5", "s").replace("9", "g").replace("1", "l").replace("$", "s").replace("|", "l")
    out = {base} if base != word else set()
    if base != word and "1" in word:
        out.add(word.replace("@", "a").replace("0", "o").replace("5", "s").replace("9", "g").replace("1", "i"))
    single = set()
    for a, b in _EDITS:
        at = base.find(a)
        while at >= 0:
            single.add((at, base[:at] + b + base[at + len(a) :], len(b)))
            at = base.find(a, at + 1)
    out |= {w for _, w, _ in single}
    out |= {base[:k] + accented + base[k + 1 :] for k, c in enumerate(base) for accented in LOST_ACCENTS.get(c, "")}
    if len(word) >= 6:
        for at, w, size in single:
            for a, b in _EDITS:
                second = w.find(a, at + size)
                while second >= 0:
                    out.add(w[:second] + b + w[second + len(a) :])
                    second = w.find(a, second + 1)
    out.discard(word)
    return out


def links(vocab: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """(word, target, n_word, n_target): every rare word with each far more frequent word it may be a misreading of, be it by rows or where equal texts count once."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(w, int(n), int(m), r) for w, n, m in zip(batch["word"], batch["n"], batch["n_apart"]) if len(w) > 1 and not w.isdigit() for r in repairs(w)]
            if rows:
                yield pd.DataFrame(rows, columns=["word", "n_word", "apart_word", "target"])

    tried = vocab.mapInPandas(emit, "word string, n_word bigint, apart_word bigint, target string")
    frequent = vocab.where(F.col("n") >= least).select(F.col("word").alias("target"), F.col("n").alias("n_target"), F.col("n_apart").alias("apart_target"))
    far = (F.col("n_target") >= ratio * F.col("n_word")) | ((F.col("apart_target") >= ratio * F.col("apart_word")) & (F.col("apart_target") >= least))
    return tried.join(frequent, "target").where(far).select("word", "target", "n_word", "n_target")


def bucket(word: str) -> int:
    return crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        value = bucket(word)
        if len(self) < 500_000:
            self[word] = value
        return value


SCAN = "field_name string, row_id bigint, line_no bigint, kind string, word string, other string, line_2 bigint, cut bigint, context array<int>, vector binary"


def scan(texts: DataFrame, doubtful: Bloom, targets: Bloom) -> DataFrame:
    """One pass over texts(field_name, row_id, t, title). kinds: page_line, break, number, doubt, vector."""
    names = [x.split()[0] for x in SCAN.split(", ")]

    def counted(index: Targets, vectors: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame([(None, None, None, "vector", w, None, None, None, None, v.astype("<i4").tobytes()) for w, v in zip(index.words, vectors) if v.any()], columns=names)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doubt, index, memo = Member(doubtful), Targets(targets), _Buckets()
        chunks = Chunks(doubt)
        vectors = np.zeros((1024, BUCKETS), np.int64)
        for batch in batches:
            rows: list[tuple] = []
            flow: list[str] = []
            for field, row, t, title in zip(batch["field_name"], batch["row_id"], batch["t"], batch["title"]):
                lines = t.split("\n")
                out = furniture(lines, title, field != "text") if len(lines) > 2 else set()
                rows += [(field, row, i, "page_line", None, None, None, None, None, None) for i in out]
                found = breaks(lines, out) if len(lines) > 1 and LINE_MARK(t) else []
                if not out and not found:  # nothing to tell apart by line unless a word is doubtful
                    parts = [chunks[c] for c in t.split()]
                    if not any(bad or True in doubts for _, doubts, bad in parts):
                        for ws, _, _ in parts:
                            flow += ws
                        flow += ["", ""]
                        continue
                joined: dict[int, tuple] = {}
                for i, j, mark, left, right in found:
                    sure = mark in "¬­"
                    rows.append((field, row, i, "break", f"{left}{right}".lower(), None if sure else f"{left}-{right}".lower(), j, len(left), None, None))
                    joined[i] = (j, left, right)
                carry = None
                for i, x in enumerate(lines):
                    if i in out or not x:
                        continue
                    parts = [chunks[c] for c in x.split()]
                    low = [w for ws, _, _ in parts for w in ws]
                    doubts = [d for _, ds, _ in parts for d in ds]
                    if not low:
                        continue
                    at = 0
                    if carry and carry[1] == i:
                        whole = (carry[2] + low[0]).lower()
                        flow.append(whole)
                        if doubt[whole] or any(c in whole for c in MIXED):
                            rows.append((field, row, carry[0], "doubt", whole, f"{carry[2]}-{low[0]}".lower(), i, len(carry[2]), [memo[w] for w in (flow[-3:-1] + low[1:3])], None))
                        at, carry = 1, None
                    end = len(low)
                    if i in joined:
                        end -= 1
                        carry = (i, joined[i][0], low[-1] if end >= at else "")
                        if end < at:
                            carry = None
                    if True in doubts:
                        for k in range(at, end):
                            if doubts[k]:
                                rows.append((field, row, i, "doubt", low[k], None, None, None, [memo[w] for w in ((flow[-2:] if k == at else low[max(0, k - 2) : k]) + low[k + 1 : k + 3])], None))
                    flow += low[at:end]
                    if any(bad for _, _, bad in parts):
                        rows.append((field, row, i, "number", None, None, None, None, None, None))
                flow += ["", ""]
            if flow:
                place = np.fromiter((index[w] for w in flow), np.int64, len(flow))
                hashed = np.fromiter((memo[w] if w else -1 for w in flow), np.int64, len(flow))
                if len(index.words) > len(vectors):
                    vectors = np.concatenate([vectors, np.zeros((len(index.words), BUCKETS), np.int64)])
                for step in range(1, WINDOW + 1):
                    for a, b in ((place[step:], hashed[:-step]), (place[:-step], hashed[step:])):
                        good = (a >= 0) & (b >= 0)
                        vectors += np.bincount(a[good] * BUCKETS + b[good], minlength=vectors.size).reshape(vectors.shape)
            if rows:
                yield pd.DataFrame(rows, columns=names)
            if len(index.words) > FLUSH_TARGETS or len(index) > 500_000:
                yield counted(index, vectors)
                index.start_anew()
                vectors = np.zeros((1024, BUCKETS), np.int64)
        yield counted(index, vectors)

    return texts.where("t is not null and row_id is not null").select("field_name", "row_id", "t", "title").mapInPandas(emit, SCAN)


def _sum_vectors(vectors: DataFrame) -> DataFrame:
    """(target, counts): the tasks' counts added up; equal words come one after the other."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word, total = None, np.zeros(BUCKETS, np.int64)
        for batch in batches:
            done = []
            for w, v in zip(batch["word"], batch["vector"]):
                if w != word:
                    done += [] if word is None else [(word, total.tolist())]
                    word, total = w, np.zeros(BUCKETS, np.int64)
                total = total + np.frombuffer(v, "<i4")
            if done:
                yield pd.DataFrame(done, columns=["target", "counts"])
        if word is not None:
            yield pd.DataFrame({"target": [word], "counts": [total.tolist()]})

    return vectors.select("word", "vector").repartition("word").sortWithinPartitions("word").mapInPandas(add, "target string, counts array<bigint>")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def word_vectors(counts: np.ndarray, contexts: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """The vectors that fit words' context counts best, the contexts' vectors given: the loss of skip-grams with NEGATIVES samples from the noise for each pair, by gradient."""
    n = counts.sum(axis=1, keepdims=True)
    share = counts / np.maximum(n, 1)
    w = np.zeros((len(counts), DIM), np.float32)
    rate = 4 / ((1 + NEGATIVES) * float((contexts**2).sum(axis=1).max()))
    for _ in range(STEPS):
        s = _sigmoid(w @ contexts.T)
        w += rate * ((share * (1 - s) - NEGATIVES * noise * s) @ contexts - w / np.maximum(n, 1))
    return w


def skip_grams(counted: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """The vectors of the contexts and (target, vector), learnt from (target, counts). The driver sees BUCKETS rows a round."""
    fields = ", ".join(f"x{k} double" for k in range(DIM))

    def matrix(batch: pd.DataFrame) -> np.ndarray:
        return np.array(batch["counts"].tolist(), np.float32).reshape(len(batch), BUCKETS)

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"bucket": np.arange(BUCKETS), "n": matrix(batch).sum(axis=0).astype(float)})

    total = np.ones(BUCKETS)
    for r in counted.mapInPandas(totals, "bucket int, n double").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r.bucket] += r.n
    noise = (total**0.75 / (total**0.75).sum()).astype(np.float32)
    contexts = np.random.default_rng(SEED).normal(scale=0.5, size=(BUCKETS, DIM)).astype(np.float32)
    for _ in range(ROUNDS):

        def gradients(batches: Iterator[pd.DataFrame], contexts: np.ndarray = contexts) -> Iterator[pd.DataFrame]:
            for batch in batches:
                counts = matrix(batch)
                w = word_vectors(counts, contexts, noise)
                n = counts.sum(axis=1, keepdims=True)
                s = _sigmoid(w @ contexts.T)
                out = (counts * (1 - s) - NEGATIVES * n * noise * s).T @ w
                frame = pd.DataFrame(out.astype(float), columns=[f"x{k}" for k in range(DIM)])
                yield frame.assign(bucket=np.arange(BUCKETS), n=(counts + NEGATIVES * n * noise).sum(axis=0).astype(float))

        summed = counted.mapInPandas(gradients, f"{fields}, bucket int, n double").groupBy("bucket").agg(*[F.sum(f"x{k}").alias(f"x{k}") for k in range(DIM)], F.sum("n").alias("n")).collect()
        contexts = contexts.copy()
        for r in summed:
            contexts[r.bucket] += np.array([r[f"x{k}"] for k in range(DIM)], np.float32) / max(r.n, 1.0)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"target": batch["target"], "vector": word_vectors(matrix(batch), contexts, noise).tolist()})

    return contexts, counted.mapInPandas(learn, "target string, vector array<float>")


def fit(contexts: np.ndarray):
    """How much better than chance a target's vector explains some neighbours: the mean of what the vectors have for log ratios."""

    def of(vector: pd.Series, context: pd.Series) -> pd.Series:
        shift = float(np.log(NEGATIVES))
        return pd.Series([0.0 if v is None or c is None or len(c) == 0 else float((contexts[np.asarray(c, int)] @ np.asarray(v, np.float32)).mean()) + shift for v, c in zip(vector, context)])

    return F.pandas_udf(of, "double")


def _change(word: Column, target: Column) -> tuple[Column, Column]:
    """The first and the last place at which a word and its target differ, by the word's places."""

    def places(w: pd.Series, t: pd.Series) -> pd.DataFrame:
        a, b = [], []
        for x, y in zip(w, t):
            p = 0
            while p < min(len(x), len(y)) and x[p] == y[p]:
                p += 1
            q = 0
            while q < min(len(x), len(y)) - p and x[-1 - q] == y[-1 - q]:
                q += 1
            a.append(p)
            b.append(max(p, len(x) - 1 - q))
        return pd.DataFrame({"first": a, "last": b})

    places_udf = F.pandas_udf(places, "first bigint, last bigint")
    return places_udf(word, target)


class Findings:
    """What one run over the texts found; each part was written once."""

    def __init__(self, texts: DataFrame, corpus: DataFrame | None = None):
        """texts: field_name, row_id, t, title. corpus: t of further texts that only count."""
        own = texts.select("t")
        vocab = materialize(vocabulary(own if corpus is None else own.unionByName(corpus.select("t"))), "vocabulary")
        linked = materialize(links(vocab), "word-links")
        rare = linked.select("word").distinct()
        # no word holds these glyphs among its letters, whatever it may have been
        mixed = F.col("word").rlike(r"^[\p{L}@0159-]+$") & F.col("word").rlike("[@0159]") & (F.length(F.regexp_replace("word", r"[@0159]", "")) >= 3) & (F.length(F.regexp_replace("word", r"[^@0159]", "")) <= 3) & ~F.col("word").rlike(r"^[@0159]+\p{L}|\p{L}[01-9]+$|^\p{L}+@\p{L}+-|[0159]{2}")
        doubtful = bloom.build(rare.unionByName(vocab.where("n = 1").where(mixed).select("word")).distinct(), "word", words=True)
        targets = bloom.build(linked.select("target").distinct(), "target", words=True)
        self.marks = materialize(scan(texts, doubtful, targets), "scan-marks")
        self.vocab, self.linked = vocab, linked
        good = vocab.where("n > 1").join(rare, "word", "left_anti").select("word")
        wanted = linked.select(F.col("target").alias("word")).distinct()
        counted = materialize(_sum_vectors(self.marks.where("kind = 'vector'").join(wanted, "word", "left_semi")), "context-counts")
        contexts, vectors = skip_grams(counted)
        doubts = self.marks.where("kind = 'doubt'").select("field_name", "row_id", "line_no", "word", "other", "line_2", "cut", "context").distinct()
        # a broken word that is good with its mark is none in doubt
        doubts = doubts.where("other is null").unionByName(doubts.where("other is not null").join(good.withColumnRenamed("word", "other"), "other", "left_anti")).drop("other")
        tried = doubts.join(linked, "word").join(vectors, "target", "left").withColumn("fit", F.round(fit(contexts)(F.col("vector"), F.col("context")), 4))
        best = Window.partitionBy("field_name", "row_id", "line_no", "word", "line_2", "context").orderBy(F.desc("score"), F.desc("n_target"), "target")
        scored = tried.withColumn("score", F.col("fit") + 0.25 * F.log("n_target")).withColumn("rank", F.row_number().over(best)).where("rank = 1")
        better = (F.col("fit") + 0.25 * F.log(F.col("n_target") / F.col("n_word")) > LEAVE) | F.col("word").rlike(r"\p{L}[@0159$|€]|[@0159$|€]\p{L}")
        self.corrections = materialize(scored.where(better).select("field_name", "row_id", "line_no", "word", "target", "line_2", "cut", "score", "fit"), "corrections")
        self.mixed = doubts.where(mixed).join(rare, "word", "left_anti").join(good, "word", "left_anti")

    def broken(self) -> DataFrame:
        """(field_name, row_id, line_no, line_2, word): the breaks whose mark does not belong to the word."""
        b = self.marks.where("kind = 'break'")
        n_joined = self.vocab.select("word", F.col("n").alias("n_joined"))
        n_marked = self.vocab.select(F.col("word").alias("other"), F.col("n").alias("n_marked"))
        both = b.join(n_marked, "other", "left").join(n_joined, "word", "left")
        return both.where(F.col("n_marked").isNull() | (F.coalesce("n_joined", F.lit(0)) >= F.col("n_marked"))).select("field_name", "row_id", "line_no", "line_2", "word").distinct()

    def misread(self) -> DataFrame:
        """(field_name, row_id, line_no) of lines with a misread word or number."""
        change = _change(F.col("word"), F.col("target"))
        c = self.corrections.withColumn("at", change)
        upper = c.where(F.col("cut").isNull() | (F.col("at.first") < F.col("cut"))).select("field_name", "row_id", "line_no")
        lower = c.where(F.col("cut").isNotNull() & (F.col("at.last") >= F.col("cut"))).select("field_name", "row_id", F.col("line_2").alias("line_no"))
        glyph = F.regexp_instr("word", F.lit("[@0159]")) - 1
        m = self.mixed.withColumn("line_no", F.when(F.col("cut").isNotNull() & (glyph >= F.col("cut")), F.col("line_2")).otherwise(F.col("line_no"))).select("field_name", "row_id", "line_no")
        numbers = self.marks.where("kind = 'number'").select("field_name", "row_id", "line_no")
        return upper.unionByName(lower).unionByName(m).unionByName(numbers).distinct()

    def defects(self) -> DataFrame:
        """(field_name, row_id, line_no, defect)."""
        kind = lambda df, d: df.select("field_name", "row_id", "line_no", F.lit(d).alias("defect"))
        return kind(self.broken(), "hyphen").unionByName(kind(self.marks.where("kind = 'page_line'"), "page_line")).unionByName(kind(self.misread(), "char")).distinct()

    def repaired(self, texts: DataFrame) -> DataFrame:
        """texts with t in continuous paragraphs."""
        key = ["field_name", "row_id"]
        glyphs = self.mixed.select(*key, "line_no", "line_2", "word", F.translate("word", MIXED, MIXED_TRUE).alias("target"), F.lit(0.0).alias("score"))
        words = self.corrections.select(*key, "line_no", "line_2", "word", "target", "score").unionByName(glyphs)
        fixes = words.groupBy(*key).agg(F.collect_set(F.struct("score", "target", "line_no", "line_2", "word")).alias("fixes"))
        joins = self.broken().groupBy(*key).agg(F.collect_set("line_no").alias("joins"))
        gone = self.marks.where("kind = 'page_line'").groupBy(*key).agg(F.collect_set("line_no").alias("gone"))
        numbers = self.marks.where("kind = 'number'").groupBy(*key).agg(F.lit(True).alias("numbers"))
        marked = texts.join(fixes, key, "left").join(joins, key, "left").join(gone, key, "left").join(numbers, key, "left")

        def mend(field: pd.Series, t: pd.Series, fixes: pd.Series, joins: pd.Series, gone: pd.Series, numbers: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else _mend(x, f, j, g, n is not None and bool(n), name != "text") for name, x, f, j, g, n in zip(field, t, fixes, joins, gone, numbers)], dtype=object)

        return marked.withColumn("t", F.pandas_udf(mend, "string")("field_name", "t", "fixes", "joins", "gone", F.coalesce("numbers", F.lit(False)))).drop("fixes", "joins", "gone", "numbers")


def _as_written(word: str, target: str) -> str:
    if word.isupper() and len(word) > 1:
        return target.upper()
    return target[:1].upper() + target[1:] if word[:1].isupper() else target


def _flows(line: str, follow: str, width: int) -> bool:
    """Whether a line of a document goes on in the next one: broken amid a sentence, or full in a text set to a width."""
    if line[-1:] not in ".!?:" and follow[:1].islower():
        return True
    return width <= PAGE_WIDTH and len(line) + 1 + len(follow.split(" ")[0]) > width


LAST_WORD = re.compile(r"[\w@]+(?:-[\w@]+)*$")


def _mend(text: str, fixes, joins, gone, numbers: bool = False, page: bool = True) -> str:
    """page: the text is one piece of a page, so all its lines flow; in a document a line may also be a paragraph."""
    lines = text.split("\n")
    clean = fixes is None and joins is None and gone is None and not numbers
    if clean and len(lines) == 1:
        return canonical(text)
    drop = set() if gone is None else {int(i) for i in gone}
    joined = set() if joins is None else {int(i) for i in joins}
    inside: dict[int, dict[str, str]] = {}  # what words of a line shall be, and words broken at its end
    across: dict[int, dict[str, str]] = {}
    for f in sorted(fixes if fixes is not None else [], key=lambda f: (f["score"], f["target"])):
        (inside if f["line_2"] is None else across).setdefault(int(f["line_no"]), {})[f["word"]] = f["target"]

    def corrected(i: int, x: str) -> str:
        own = inside.get(i)
        return TOKEN.sub(lambda m: _as_written(m.group(), own[m.group().lower()]) if m.group().lower() in own else m.group(), x) if own else x

    width = max((len(x.rstrip()) for i, x in enumerate(lines) if i not in drop), default=0)
    paragraphs, now, last, pending, flowed = [], "", "", None, False
    parted = dropped = False  # since the last line that was kept: a blank line, furniture
    for i, x in enumerate(lines):
        if i in drop:
            dropped = True
            continue
        kept = i not in joined and bool(BREAK.search(x))  # the mark belongs to the word
        raw = x.strip()
        x = canonical(x.rstrip()[:-1] if i in joined else x.rstrip()).strip()
        if not x:
            parted = True
            continue
        if now and pending is None:
            ends = now.rstrip()[-1:] in ".!?:"
            if page:
                new = parted and ends
            elif parted or dropped:
                new = ends or (parted and not dropped)
            else:
                new = not _flows(last, raw, width)
            if new:
                paragraphs.append(now)
                now = ""
        flowed = flowed or bool(now)
        if pending is None:
            now = f"{now} {corrected(i, x)}" if now else corrected(i, x)
        else:  # the word across the line end is corrected as one
            left, right = LAST_WORD.search(now), TOKEN.match(x)
            whole = left.group() + right.group() if left and right else ""
            target = across.get(pending, {}).get(whole.lower()) if whole else None
            if target is None:
                now += corrected(i, x)
            else:
                now = now[: left.start()] + _as_written(whole, target) + corrected(i, x[right.end() :])
        last, parted, dropped = raw, False, False
        pending = i if i in joined or kept else None
    if clean and not flowed:
        return canonical(text)
    paragraphs.append(now)
    return NUMBER.sub(lambda m: m.group().translate(DIGITS), "\n".join(p for p in paragraphs if p))
