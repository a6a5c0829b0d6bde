from pyspark.sql import functions as F

from leafloom.operators import report, wrap
from leafloom.plans.records import sequence_numbers

TEXTS = "page_id string, node_id string, node_no long, x long, y long, w long, h long, size double, text string"
BOXES = "page_id string, x long, y long, w long, h long"


def test_lines():
    assert wrap.lines("aa bb cc", 10, 25) == ["aa bb", "cc"] and wrap.lines("", 10, 25) == [] and wrap.lines("a" * 90 + " b", 10, 25) == ["a" * 90, "b"]


def test_texts_are_wrapped_before_obstacles_and_push(spark):
    long = " ".join(["word"] * 20)
    texts = spark.createDataFrame([("p", "a", 1, 10, 100, 400, 20, 20.0, long), ("p", "b", 2, 10, 130, 100, 20, 20.0, "b"), ("p", "c", 3, 500, 130, 100, 20, 20.0, "c"), ("p", "d", 4, 10, 40, 100, 20, 20.0, long), ("q", "e", 1, 10, 100, 400, 20, 20.0, long), ("p", "n", 9, 10, 100, 400, 20, 20.0, None), ("r", "f", 1, 350, 0, 50, 50, 20.0, long)], TEXTS)
    walls = spark.createDataFrame([("p", 300, 90, 50, 60), ("r", 400, 0, 10, 90), ("s", 1, 1, 1, 1)], BOXES)
    got = {(r.page_id, r.node_id): r for r in wrap.around_obstacles(texts, walls).collect()}
    a = got["p", "a"]
    n = len(wrap.lines(long, 20.0, 282))
    assert a.text.count("\n") + 1 == n == 4 and a.w == 282 and a.h == round(n * 20 * 1.15)
    assert got["p", "b"].y == 130 + a.h - 20 and got["p", "c"].y == 130 and got["p", "d"].y == 40 and got["p", "d"].text == long
    assert got["q", "e"].text == long and got["r", "f"].text == long and got["p", "n"].text is None and len(got) == 7
    assert wrap.around_obstacles(texts.where("false"), walls).count() == 0


def test_reports(spark):
    df = spark.createDataFrame([("p", 2, "<b>&'\"", None), ("p", 1, "x", "y"), ("q", 1, None, "")], "page string, k int, a string, c string")
    rows = {r.page: r for r in report.table(df, "page", ["k"], {"A": "a", "C": "c"}, "T").collect()}
    assert rows["p"].n_rows == 2 and rows["p"].html.endswith("<tbody><tr><td>x</td><td>y</td></tr><tr><td>&lt;b&gt;&amp;&#x27;&quot;</td><td></td></tr></tbody></table>")
    cards = {r.page: r.html for r in report.cards(df, "page", ["k"], "k", {"A": F.col("a")}, ["c", "a"], "T").collect()}
    assert "<textarea>y</textarea>" in cards["p"] and "<textarea></textarea>" in cards["q"]
    both = report.side_by_side(df.where("page = 'p'").select("page", F.lit("l").alias("html")).distinct(), df.where("page = 'q'").select("page", F.lit("r").alias("html")), "page", "T")
    assert sum("missing" in r.html for r in both.collect()) == 2


def test_numbers_of_ranges(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)] + [(None, 9)] * 1, "g long, i long")
    got = [(r.g, r.i) for r in sequence_numbers(df, [F.col("g"), F.col("i")]).orderBy("pos").collect()]
    assert got == [(None, 9)] + sorted((i % 7, i) for i in range(500))
