"""Kernels on drawn pages of 300 by 320 pixels: a rule, two lines of text, a slanted stroke; what they must find follows from how they were drawn."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from leafloom.operators import detect as D
from leafloom.operators import image as I
from leafloom.plans import query
from leafloom.session import read

HEIGHT, WIDTH = 320, 300
DRAWN = "d as (select s_suppkey as page_id, 250 - s_suppkey % 5 as paper, 40 + s_suppkey % 20 as rule_y, 200 + s_suppkey % 50 as rule_w, 50 + s_suppkey % 10 as text_x, 140 + s_suppkey % 30 as text_w from supplier)"


def drawn(spark, sf, slant: bool = False):
    """(page_id, height, width, data); the numbers are those of DRAWN."""

    def one(key: pd.Series) -> pd.Series:
        out = []
        for k in key.tolist():
            img = np.full((HEIGHT, WIDTH), 250 - k % 5, np.uint8)
            if slant:
                for x in range(20, 280):
                    y = 150 + (x - 20) // (20 + k % 20)
                    img[y : y + 2, x] = 0
            else:
                img[40 + k % 20 : 43 + k % 20, 30 : 230 + k % 50] = 0
                for y in (100, 130):
                    img[y : y + 12, 50 + k % 10 : 190 + k % 10 + k % 30] = 10
            out.append(img.tobytes())
        return pd.Series(out)

    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("page_id"))
    return s.select("page_id", F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"), F.pandas_udf(one, "binary")("page_id").alias("data"))


BOX = "x bigint, y bigint, w bigint, h bigint"


@query("img_rules", f"with {DRAWN} select page_id, 30 as x, rule_y as y, rule_w as w, 3 as h from d")
def rules(spark, sf):
    return I.per_image(drawn(spark, sf), I.horizontal_rules, BOX)


@query("img_parts", f"with {DRAWN} select page_id, 30 as x, rule_y as y, rule_w as w, 3 as h, 3*rule_w as area from d union all select page_id, text_x, y, text_w, 12, 12*text_w from d, (values (100), (130)) v(y)")
def parts(spark, sf):
    return I.per_image(drawn(spark, sf), lambda img: I.components(I.ink(img)), f"{BOX}, area bigint")


@query("img_text_rows", f"with {DRAWN} select page_id, text_x as x, y, text_w as w, 12 as h from d, (values (100), (130)) v(y)")
def text_rows(spark, sf):
    return I.per_image(drawn(spark, sf), lambda img: [r for r in I.rows(img) if r[1] > 70], BOX)


@query("img_line_boxes", f"with {DRAWN} select page_id, greatest(0, text_x-4) as x, y-4-90 as y, text_w+8 as w, 20 as h from d, (values (100), (130)) v(y)")
def line_boxes(spark, sf):
    """Two lines of a cut-out text block, with their margin."""
    return I.per_image(drawn(spark, sf), lambda img: I.line_boxes(img[90:160], 2), BOX)


@query("img_skew", "select s_suppkey as page_id, true as near from supplier")
def skew(spark, sf):
    """The slope of a slanted stroke, to a third of a degree."""
    found = I.per_image(drawn(spark, sf, slant=True), lambda img: [(float(I.skew(img)),)], "degrees double")
    true = F.degrees(F.atan(1 / (20 + F.col("page_id") % 20)))
    return found.select("page_id", (F.abs(F.abs("degrees") - true) < 0.34).alias("near"))


@query("img_rotated", "select s_suppkey as page_id, 320 as w, 300 as h from supplier")
def rotated(spark, sf):
    """Canvas after a quarter turn."""
    return I.per_image(drawn(spark, sf), lambda img: [(int(r.shape[1]), int(r.shape[0])) for r in [I.rotated(img, 90.0)]], "w bigint, h bigint")


@query("img_crop_ink", f"with {DRAWN} select page_id, 210 as w, 50 as h, 12*(least(text_x+text_w, 240) - text_x) as dark from d")
def crop_ink(spark, sf):
    """Size and ink of a crop with a margin; the margin is white."""
    return I.per_image(drawn(spark, sf), lambda img: [(c.shape[1], c.shape[0], int((c < 128).sum())) for c in [I.cropped(img, 40, 85, 200, 40, 5)]], "w bigint, h bigint, dark bigint")


@query("img_page_color", f"with {DRAWN} select page_id, paper from d")
def page_color(spark, sf):
    return I.per_image(drawn(spark, sf), lambda img: [(int(I.page_color(img)),)], "paper bigint")


@query("img_painted_ink", f"with {DRAWN} select page_id, 24*text_w as dark, 12*text_w as without_line from d")
def painted_ink(spark, sf):
    """Ink left when the rule, and then the first line, is painted over."""
    k = lambda img, boxes: int((I.painted(img.copy(), boxes) < 128).sum())
    return I.per_image(drawn(spark, sf), lambda img: [(k(img, [(0, 30, 300, 40)]), k(img, [(0, 30, 300, 40), (0, 95, 300, 20)]))], "dark bigint, without_line bigint")


@query("img_margins_ink", f"with {DRAWN} select page_id, 12*(text_x+text_w-60) as dark from d")
def margins_ink(spark, sf):
    """Ink left between filled margins."""
    return I.per_image(drawn(spark, sf), lambda img: [(int((I.margins_filled(img.copy(), 70, 190, 60, 0) < 128).sum()),)], "dark bigint")


@query("img_stretched", f"with {DRAWN} select page_id, 255 as brightest, true as darker from d")
def stretched(spark, sf):
    return I.per_image(drawn(spark, sf), lambda img: [(int(c.max()), bool(c.min() <= img.min())) for c in [I.stretched(img)]], "brightest bigint, darker boolean")


@query("img_edges", f"with {DRAWN} select page_id, true as at_edges from d")
def edges(spark, sf):
    """Edges lie along the drawn shapes only."""

    def kernel(img: np.ndarray) -> list[tuple]:
        shapes = img < 128
        near = shapes.copy()
        for dy in range(-4, 5):
            for dx in range(-4, 5):
                near |= np.roll(np.roll(shapes, dy, 0), dx, 1)
        found = I.gradient(img) > 0
        return [(bool(found.any() and not (found & ~near).any()),)]

    return I.per_image(drawn(spark, sf), kernel, "at_edges boolean")


@query("img_detected", f"with {DRAWN} select page_id, 'rule' as kind, 1 as n from d")
def detected(spark, sf):
    """The rule among the regions that the detector gives for a page."""
    found = I.per_image(drawn(spark, sf), D.detect, D.SCHEMA)
    return found.where("kind = 'rule' and h = 3 and x = 30").groupBy("page_id", "kind").agg(F.count("*").alias("n"))


@query("img_footer_line", "select s_suppkey as page_id, s_suppkey % 3 <> 0 as has_line, case when s_suppkey % 3 <> 0 then true end as near from supplier")
def footer_line(spark, sf):
    """The slope of a line near the foot of the page, where there is one; a shorter straight one beside it does not win."""
    blank = np.full((HEIGHT, WIDTH), 250, np.uint8)

    def kernel(k: int) -> float | None:
        img = blank.copy()
        for x in range(10, 290) if k % 3 else ():
            y = 270 + (x - 10) // 100 * (k % 3 - 1)
            img[y : y + 2, x] = 0
        img[300:302, 100:195] = 0
        return I.footer_line(img)

    found = F.pandas_udf(lambda key: pd.Series([kernel(k) for k in key.tolist()], dtype=float), "double")
    d = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("page_id")).withColumn("degrees", F.nanvl(found("page_id"), F.lit(None).cast("double")))
    true = F.degrees(F.atan(F.when(F.col("page_id") % 3 == 2, 0.01).otherwise(0.0)))
    return d.select("page_id", F.col("degrees").isNotNull().alias("has_line"), (F.abs(F.col("degrees") - true) < 0.2).alias("near"))
