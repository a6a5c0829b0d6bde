"""Boxes as struct columns (x, y, w, h), origin top left, and affine matrices as structs (a, b, c, d, e, f)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def right(b: Column) -> Column:
    return b["x"] + b["w"]


def bottom(b: Column) -> Column:
    return b["y"] + b["h"]


def area(b: Column) -> Column:
    return b["w"] * b["h"]


def _overlap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b))


def overlap_x(a: Column, b: Column) -> Column:
    return _overlap(a["x"], right(a), b["x"], right(b))


def overlap_y(a: Column, b: Column) -> Column:
    return _overlap(a["y"], bottom(a), b["y"], bottom(b))


def overlap_area(a: Column, b: Column) -> Column:
    return overlap_x(a, b) * overlap_y(a, b)


def intersects(a: Column, b: Column) -> Column:
    return (a["x"] < right(b)) & (b["x"] < right(a)) & (a["y"] < bottom(b)) & (b["y"] < bottom(a))


def intersection(a: Column, b: Column) -> Column:
    """The common box, null when there is none."""
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    return F.when(intersects(a, b), box(x, y, F.least(right(a), right(b)) - x, F.least(bottom(a), bottom(b)) - y))


def iou(a: Column, b: Column) -> Column:
    both = overlap_area(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def fraction(a: Column, b: Column) -> Column:
    """The part of a that b covers, 0 for an empty a."""
    return F.when(area(a) > 0, overlap_area(a, b) / area(a)).otherwise(F.lit(0.0))


def y_ratio(a: Column, b: Column) -> Column:
    """Common height against the lower of the two."""
    return overlap_y(a, b) / F.greatest(F.lit(1), F.least(a["h"], b["h"]))


def contains(outer: Column, inner: Column, pad: Column | int = 0) -> Column:
    p = F.lit(pad) if isinstance(pad, int) else pad
    return (inner["x"] >= outer["x"] - p) & (inner["y"] >= outer["y"] - p) & (right(inner) <= right(outer) + p) & (bottom(inner) <= bottom(outer) + p)


def clip(b: Column, width: Column, height: Column) -> Column:
    """The part inside a page, null when nothing is left."""
    return intersection(b, box(F.lit(0), F.lit(0), width, height))


def clamp(b: Column, width: Column, height: Column) -> Column:
    """Moved inside a page; at least one pixel each way."""
    x, y = F.least(F.greatest(b["x"], F.lit(0)), width - 1), F.least(F.greatest(b["y"], F.lit(0)), height - 1)
    return box(x, y, F.greatest(F.lit(1), F.least(right(b), width) - x), F.greatest(F.lit(1), F.least(bottom(b), height) - y))


def inflate(b: Column, pad: int, width: Column, height: Column) -> Column:
    return clamp(box(b["x"] - pad, b["y"] - pad, b["w"] + 2 * pad, b["h"] + 2 * pad), width, height)


def scaled(b: Column, sx: Column, sy: Column) -> Column:
    """Half-even rounding; at least one pixel each way."""
    r = lambda v: F.bround(v).cast("bigint")
    return box(r(b["x"] * sx), r(b["y"] * sy), F.greatest(F.lit(1), r(b["w"] * sx)), F.greatest(F.lit(1), r(b["h"] * sy)))


def delta(a: Column, b: Column) -> Column:
    """The largest difference of any side."""
    return F.greatest(*[F.abs(a[k] - b[k]) for k in "xywh"])


def to_page(b: Column, page_height: Column, media_height: Column) -> Column:
    """From user space, origin bottom left, to the page, origin top left, in the page's scale."""
    s = page_height / media_height
    return box(b["x"] * s, (media_height - b["y"] - b["h"]) * s, b["w"] * s, b["h"] * s)


def matrix(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    return F.struct(*[v.cast("double").alias(k) for k, v in zip("abcdef", (a, b, c, d, e, f))])


def times(m: Column, n: Column) -> Column:
    """The map that applies n first, then m."""
    return matrix(
        m["a"] * n["a"] + m["c"] * n["b"], m["b"] * n["a"] + m["d"] * n["b"], m["a"] * n["c"] + m["c"] * n["d"],
        m["b"] * n["c"] + m["d"] * n["d"], m["a"] * n["e"] + m["c"] * n["f"] + m["e"], m["b"] * n["e"] + m["d"] * n["f"] + m["f"],
    )


def move(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def css(b: Column) -> Column:
    return F.format_string("left:%dpx;top:%dpx;width:%dpx;height:%dpx", b["x"], b["y"], b["w"], b["h"])
