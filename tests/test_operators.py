"""Operators on literal inputs, and every query beside its SQL twin on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leafloom.operators import image as I
from leafloom.functions import text as T
from leafloom.operators import content, match, render
from leafloom.operators import sequence as S
from leafloom.operators import tree as R
from scripts.compare import cell

SF = "/root/testdata/sf0.001"
CORE = sorted(set(entry.plans.ORACLES))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for p in Path(SF).iterdir():
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", CORE)
def test_twin(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    names = sorted(df.columns)
    got = Counter(tuple(cell(r[c]) for c in names) for r in df.collect())
    at = [rel.columns.index(c) for c in names]
    assert got == Counter(tuple(cell(r[i]) for i in at) for r in rel.fetchall())


def test_gaps_conserve_length(spark):
    frames = spark.createDataFrame([("a", 0, 100), ("b", 10, 20)], "k string, lo long, hi long")
    blocks = spark.createDataFrame([("a", 10, 20), ("a", 15, 30), ("a", 90, 120), ("b", 0, 50)], "k string, lo long, hi long")
    assert sorted(tuple(r) for r in S.gaps(frames, blocks, ["k"], "lo", "hi").collect()) == [("a", 0, 10), ("a", 30, 90)]
    assert sorted(tuple(r) for r in S.union_of_intervals(blocks, ["k"], "lo", "hi").collect()) == [("a", 10, 30), ("a", 90, 120), ("b", 0, 50)]


def test_as_of_and_tiles(spark):
    rows = spark.createDataFrame([("p", 5, "x"), ("p", 10, "y"), ("q", 1, "z")], "k string, at long, id string")
    marks = spark.createDataFrame([("p", 10, "ten"), ("p", 0, "zero")], "k string, at long, v string")
    assert {r.id: r.v for r in match.as_of(rows, marks, ["k"], "at", "v").collect()} == {"x": "zero", "y": "ten", "z": None}
    b = spark.createDataFrame([(0, 0, 25, 5)], "x long, y long, w long, h long").select(F.struct("x", "y", "w", "h").alias("b"))
    assert match.tiled(b, F.col("b"), 10).count() == 3


def test_paths_leave_cycles_out(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "d"), ("d", "c"), ("e", "gone")], "n string, p string")
    assert {r.n: r.path for r in R.paths(df, "n", "p").collect()} == {"a": ["a"], "b": ["a", "b"]}


def test_image_kernels():
    img = np.full((60, 200), 255, np.uint8)
    img[10:12, 20:180] = 0
    img[30:40, 50:120] = 0
    assert I.content_box(img) == (20, 10, 160, 30) and I.runs(np.array([1, 1, 0, 1, 0, 0, 1, 1], bool), 2, 4) == [(0, 8)]
    assert [c[:4] for c in I.components(img < 210)] == [(20, 10, 160, 2), (50, 30, 70, 10)] and I.horizontal_rules(img) == [(20, 10, 160, 2)]
    assert I.rows(img) == [(20, 10, 160, 2), (50, 30, 70, 10)] and I.expanded([(0, 8), (9, 11)], 3) == [(0, 4), (4, 8), (9, 11)]
    assert I.cropped(img, -5, -5, 10, 10).shape == (10, 10) and (I.margins_filled(img, 20, 5, 0, 0)[:20] == 255).all() and I.page_color(img) == 255 and 0 <= I.otsu(img) < 255
    page = np.full((400, 800), 255, np.uint8)
    for y in (100, 200, 300):
        page[y : y + 3, 100:700] = 0
    assert abs(I.skew(page)) < 0.05 and abs(I.skew(I.rotated(page, 2.0)) + 2.0) < 0.35 and len(I.line_boxes(page, 3)) == 3
    assert I.gradient(page).any() and (I.stretched(page) == page).all() and I.painted(page, [(0, 0, 800, 400)]).min() == 255


def test_formulas():
    assert render.formula_html("x_T") == "x<sub>T</sub>" and render.formula_html(r"\frac{a}{b}") == "a/b" and render.formula_html("{a") == "{a"
    m = lambda x: render.formula_mathml(x).removeprefix('<math xmlns="http://www.w3.org/1998/Math/MathML">').removesuffix("</math>")
    assert m(r"\sqrt{x^2}") == "<msqrt><msup><mi>x</mi><mn>2</mn></msup></msqrt>" and m(r"\nope") == "<mi>nope</mi>" and m("") == "<mrow></mrow>"
    assert m(r"$x_{a}^{2}$") == "<msubsup><mi>x</mi><mi>a</mi><mn>2</mn></msubsup>" and m("x_a^b") == "<msub><mi>x</mi><msup><mi>a</mi><mi>b</mi></msup></msub>"
    assert m(r"\left(\frac{1}{y}\right)") == "<mrow><mo>(</mo><mfrac><mn>1</mn><mi>y</mi></mfrac><mo>)</mo></mrow>" and m(r"\vec F\,<") == '<mrow><mover accent="true"><mi>F</mi><mo>→</mo></mover><mo>,</mo><mo>&lt;</mo></mrow>'
    assert m("{a") == "<mi>a</mi>" and m("a}b") == "<mrow><mi>a</mi><mi>b</mi></mrow>" and m("{" * 5000).startswith("<mtext>{{")


def test_layout_detection(spark):
    from leafloom.operators import detect as D

    rows = [D.Row(20, 20, 180, 12), D.Row(33, 20, 180, 3), D.Row(50, 20, 180, 12)]
    kept, actions = D.clean_short(rows, 200, 300)
    assert len(kept) == 2 and [a[0] for a in actions] == ["merge_adjacent_short_row"]
    assert D.clean_short([D.Row(20, 20, 100, 30), D.Row(25, 30, 40, 3)], 200, 300)[1][0][0] == "remove_contained_short_row" and D.clean_short([], 10, 10) == ([], [])
    img = np.full((300, 500), 255, np.uint8)
    img[40:42, 30:470] = 0
    img[250:252, 30:470] = 0
    for y in (80, 120, 160):
        img[y : y + 14, 60:400] = 0
    found = D.detect(img)
    assert sum(f[0] == "rule" for f in found) == 2 and sum(f[0] == "text_band" for f in found) >= 3
    df = spark.createDataFrame([("p", 300, 500, bytearray(img.tobytes())), ("none", 1, 1, None)], "page_id string, height long, width long, data binary")
    assert I.per_image(df, D.detect, D.SCHEMA).where("kind = 'rule'").count() == 2


def test_trees_of_any_depth(spark):
    rows = [(1, k, k - 1 if k else None) for k in range(300)] + [(2, 5, 6), (2, 6, 5), (2, 7, 99), (2, 8, None), (3, 0, None)]
    got = R.paths(spark.createDataFrame(rows, "page_id long, n long, p long"), "n", "p", ["page_id"]).collect()
    assert {(r.page_id, r.n): r.path for r in got} == {**{(1, k): list(range(k + 1)) for k in range(300)}, (2, 8): [8], (3, 0): [0]}
    assert all(r.depth == len(r.path) - 1 for r in got)


def test_outline_scores(spark):
    rows = [("2 3 BEAMS", "2 3", "BEAMS"), ("BEAMS", "2 3", "BEAMS"), ("2 3", "2 3", "BEAMS UNDER LOAD"), ("UNDER A LONG LOAD", "", "BEAMS UNDER A LONG LOAD"), ("UNDER A LONG LOAD", "2 3", "BEAMS UNDER A LONG LOAD"), ("", "", "X")]
    got = [round(r.s, 2) for r in spark.createDataFrame(rows, "t string, n string, o string").coalesce(1).select(T.outline_score(F.col("t"), F.col("n"), F.col("o")).alias("s")).collect()]
    assert got[0] == got[1] == 1.0 and got[3] == 0.79 and got[4] > 0.79 and got[5] == 0.0 and got[2] < 0.5


def test_policies_and_fonts(spark):
    df = spark.createDataFrame([("  x = 5   ", True), (r"\frac{a}{b}", True), (None, False), ("a_1 + b_2", False), ("x_{1}", False), ("a" * 13, True), ("a\\\\b", False)], "t string, i boolean").coalesce(1)
    assert [r.p for r in df.select(T.render_policy(F.col("t"), F.col("i")).alias("p")).collect()] == ["text", "inline_math", "display_math", "display_math", "text", "inline_math", "display_math"]
    names = spark.createDataFrame([("/ABCDEF+Minion-Pro-Bold",), ("Times-Roman",), ("Plain",), ("ABCDEF+",)], "b string").coalesce(1)
    assert [tuple(r.p) for r in names.select(T.font_parts(F.col("b")).alias("p")).collect()] == [("Minion-Pro", "Bold", "ABCDEF"), ("Times-Roman", None, None), ("Plain", None, None), ("ABCDEF+", None, None)]


def test_spans_of_unpainted_paths(spark):
    names = "m l n m BDC l S q re W f Do m Do h B BT Tj ET BT Tj BT ET re sh Q S BT Tj".split()
    df = spark.createDataFrame([(1, i, o, float(i), 2.0, 9.0, 1.0) for i, o in enumerate(names)], "page_id long, ordinal long, operator string, x double, y double, w double, h double")
    got = sorted((r.first, r.last, r.kind, r["class"]) for r in content.classify(content.visual_spans(df)).collect())
    assert got == [
        (5, 6, "path_span", "radical_or_geometry_stroke_candidate"), (8, 10, "path_span", "thin_rule_or_fraction_bar_candidate"), (11, 11, "image_operation", "embedded_image_candidate"), (12, 15, "path_span", "filled_geometry_candidate"),
        (13, 13, "image_operation", "embedded_image_candidate"), (16, 18, "text_span", "text_content_candidate"), (21, 22, "text_span", "text_content_candidate"), (23, 26, "path_span", "radical_or_geometry_stroke_candidate"), (24, 24, "shading_operation", "shading_candidate"),
    ]


def test_model_replies(spark):
    texts = ['```json\n{"a": {"b": 1}}\n```', "so {1} is none", "none", None, '{"a": 1} and }']
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [r.o for r in df.select(T.json_object(F.col("t")).alias("o")).collect()] == ['{"a": {"b": 1}}', None, None, None, None]
    one = spark.createDataFrame([('{"output": [], "x": 1}',)], "t string").select(T.payload_text(F.col("t")).alias("o")).first().o
    assert one == '{\n  "output": [],\n  "x": 1\n}'
