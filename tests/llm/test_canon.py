import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafloom.llm import canon


def test_one_form():
    c = canon.canonical
    assert c("Ｍｅａｓｕｒｅ the ﬁlter​") == "Measure the filter"
    assert c("café") == c("café") == c("cafe​́") == c("саfе́") == "café"
    assert c("Ａ̊") == c("Å") == c("Å") == "Å"
    assert c("10 µm") == c("10 μm")
    for a, b in (("m²", "m2"), ("Case", "case"), ("a-b", "a–b"), ("é", "e"), ("a;b", "a,b"), ("a b", "a  b")):
        assert c(a) != c(b)
    assert c("") == "" and c("​﻿") == "" and c("Let λ be") == "Let λ be"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abeé́̊̈​аоѕΑΒοﬁＡｅ１ ²ÅÅ"), st.characters()), max_size=30))
def test_fixed_point(text):
    once = canon.canonical(text)
    assert canon.canonical(once) == once and unicodedata.is_normalized("NFC", once)


def test_conflicts_are_refused(monkeypatch):
    monkeypatch.setitem(canon.LIGATURES, "А", "B")
    with pytest.raises(ValueError):
        canon.build_table()


@pytest.mark.parametrize("part_rows", [5000, 2])
def test_pairs(spark, part_rows):
    rows = [(1, "café"), (2, "café"), (3, "café"), (3, "café"), (4, "Café"), (5, None), (6, ""), (7, "x"), (8, "x"), (None, "café"), (9, "саfé")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, t string, look string")
    got = sorted((r.id_a, r.id_b) for r in canon.pairs(canon.keys(df, F.col("id"), F.col("t")), part_rows).collect())
    texts = {(i, t) for i, t in rows if i is not None and t is not None}
    assert got == sorted((i, j) for i, s in texts for j, t in texts if i < j and s != t and canon.canonical(s) == canon.canonical(t))
    assert canon.pairs(canon.keys(df.where("false"), F.col("id"), F.col("t"))).count() == 0
    assert [r.t for r in canon.canonicalize(df, "t").where("id = 5 or id = 9").orderBy("id").collect()] == [None, "café"]


def test_very_long():
    assert canon.canonical("е́ " * 200_000) == "é " * 200_000
