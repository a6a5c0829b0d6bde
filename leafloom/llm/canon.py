"""Visually identical text with different characters (problem 1).

A transducer, compiled once per process from a conflict-checked table, walks over the grapheme clusters of a
text and rewrites the longest run of clusters it has a rule for at each place: width forms, ligatures, invisible
characters, kinds of space, look-alike letters of other scripts, and composed against combining accents. Case,
accents, punctuation, digits and raised digits are kept. Only texts that are not composed after that are gone over again.

The result is a form to compare texts by. Letters are replaced whatever the word's script, as the comparison asks for,
so a text of another script is not fit for reading in it.

Defined results
* null stays null; the empty text stays empty; a text of nothing but invisible characters becomes empty.
* the result is a fixed point: canonical(canonical(x)) == canonical(x).
* equal rows, repeated ids and ties: pairs() gives each pair of ids once, and none for a row with itself.
* a null id takes part in no pair; an empty table gives an empty table; extra columns play no part.
* texts of any length are processed whole.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.session import materialize

# Characters that are not drawn, spaces of any kind but line ends, and letters drawn as a Latin one.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff\ufe0e\ufe0f"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
LOOKALIKES = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТХҮԚԜӀѴаесһіјорԛѕуԝхүԁӏѵ", "ABESIJKMHOPCTXYQWIVaechijopqsywxydlv"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿονϲϳ", "ABEZHIKMNOPTYXCJovcj"),
    "Armenian": ("ՕՍԼՏօհոսցզ", "OULSohnugq"),
    "Cherokee": ("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏟᏢᏙᏚᏞᏦᏔᏒ", "DRTiyAJEWMHYGhZCPVSLKWR"),
    "Lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    "signs": ("µ", "μ"),
}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ", "ǆ": "dž", "ǅ": "Dž", "Ǆ": "DŽ", "ǉ": "lj", "ǈ": "Lj", "Ǉ": "LJ", "ǌ": "nj", "ǋ": "Nj", "Ǌ": "NJ"}
MARKS = ((0x0300, 0x036F), (0x0483, 0x0487), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F))


def width_forms() -> dict[str, str]:
    """Full and half width forms, as the character database has them."""
    forms = {}
    for code in range(0xFF01, 0xFFEF):
        kind, _, plain = unicodedata.decomposition(chr(code)).partition(" ")
        if kind in ("<wide>", "<narrow>"):
            forms[chr(code)] = "".join(chr(int(x, 16)) for x in plain.split())
    return forms


def build_table() -> dict[str, str]:
    """Single characters to what replaces them. Raises where two rules disagree or a result is rewritten again."""
    table: dict[str, str] = {}

    def add(source: str, target: str) -> None:
        if table.setdefault(source, target) != target:
            raise ValueError(f"two results for U+{ord(source):04X}")

    for c in INVISIBLE:
        add(c, "")
    for c in SPACES:
        add(c, " ")
    for name, (sources, targets) in LOOKALIKES.items():
        if len(sources) != len(targets):
            raise ValueError(name)
        for a, b in zip(sources, targets):
            add(a, b)
    for a, b in LIGATURES.items():
        add(a, b)
    for a, b in width_forms().items():
        add(a, "".join(table.get(c, c) for c in b))
    for a, b in table.items():
        if any(c in table for c in b):
            raise ValueError(f"U+{ord(a):04X} leads to another source")
    return table


class Transducer:
    """Longest match first: a base with its marks and whatever is invisible among them, else one mapped character."""

    def __init__(self, table: dict[str, str] | None = None):
        self.table = build_table() if table is None else table
        glue = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in MARKS) + "".join(re.escape(c) for c in self.table if not self.table[c])
        single = "".join(re.escape(c) for c in self.table if self.table[c])
        self.has_glue = re.compile(f"[{glue}]").search
        self.clusters = re.compile(f"[^{glue}]?[{glue}]+|[{single}]+").sub
        self.singles = re.compile(f"[{single}]+").sub
        self.known: dict[str, str] = {}

    def _result(self, match: re.Match) -> str:
        text = match.group()
        out = self.known.get(text)
        if out is None:
            plain = "".join(self.table.get(c, c) for c in text)
            if not plain.isascii():  # a mapped letter may be the base of a composed one
                plain = unicodedata.normalize("NFC", "".join(self.table.get(c, c) for c in unicodedata.normalize("NFD", plain)))
            out = plain
            if len(self.known) < 100_000:  # a memo only; what is not kept is worked out again
                self.known[text] = out
        return out

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text
        text = (self.clusters if self.has_glue(text) else self.singles)(self._result, text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
            text = self.singles(self._result, text)
        return text


_transducer: list[Transducer] = []


def canonical(text: str) -> str:
    if not _transducer:
        _transducer.append(Transducer())
    return _transducer[0](text)


def _canonical_or_null(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else canonical(t) for t in texts], dtype=object)


def canonicalize(df: DataFrame, column: str, into: str | None = None) -> DataFrame:
    """df with the column's texts, or those of a new column, in the one form."""
    return df.withColumn(into or column, F.pandas_udf(_canonical_or_null, "string")(F.col(column)))


def keys(df: DataFrame, row_id: Column, text: Column) -> DataFrame:
    """(row_id, look, raw): 128-bit keys of the canonical and of the raw text; the texts themselves are not moved."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            look, raw = [], []
            for t in batch["t"]:
                c = canonical(t)
                key = hashlib.blake2b(c.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                look.append(key)
                raw.append(key if c == t else hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            yield pd.DataFrame({"row_id": batch["row_id"], "look": look, "raw": raw})

    source = df.select(row_id.cast("bigint").alias("row_id"), text.alias("t")).where("row_id is not null and t is not null")
    return source.mapInPandas(emit, "row_id bigint, look binary, raw binary")


def pairs(keyed: DataFrame, part_rows: int = 5_000) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows that look the same though their texts differ.

    Groups of a single text are left out before anything is joined. The rows of a group of more than part_rows
    are spread over as many parts on one side and repeated for these parts on the other, so that no task
    gets a whole hot group.
    """
    keyed = materialize(keyed.distinct(), "look-keys")  # 40 bytes a row; the texts are canonicalised once
    size = keyed.groupBy("look").agg(F.count("*").alias("n"), F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("look", F.ceil(F.col("n") / part_rows).cast("int").alias("parts"))
    rows = keyed.join(size, "look")
    left = rows.withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int")).select("look", "part", F.col("row_id").alias("id_a"), F.col("raw").alias("raw_a"))
    right = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("look", "part", F.col("row_id").alias("id_b"), F.col("raw").alias("raw_b"))
    return left.join(right, ["look", "part"]).where("id_a < id_b and raw_a <> raw_b").select("id_a", "id_b").distinct()
