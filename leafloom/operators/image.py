"""Kernels on page images (numpy in Arrow batches) and what they share with the run-length tables.

An image is a row (page_id, height, width, data) with one byte per pixel, row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gray(data: bytes, height: int, width: int, channels: int = 1) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return a[:, :, 0]
    return np.rint(a[:, :, 2] * 0.299 + a[:, :, 1] * 0.587 + a[:, :, 0] * 0.114).astype(np.uint8)


def from_source(df: DataFrame) -> DataFrame:
    """Rows of Spark's image source as (page_id, height, width, n_channels, data)."""
    return df.select(F.col("image.origin").alias("page_id"), "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.data")


def per_image(images: DataFrame, kernel: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """kernel's rows for each image, with page_id first."""
    names = ["page_id", *[x.split()[0] for x in schema.split(", ")]]

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *r) for p, h, w, d in zip(batch["page_id"], batch["height"], batch["width"], batch["data"]) for r in kernel(gray(d, int(h), int(w), len(d) // max(1, int(h) * int(w))))]
            yield pd.DataFrame(rows, columns=names)

    kind = images.schema["page_id"].dataType.simpleString()
    return images.select("page_id", "height", "width", "data").where("data is not null").mapInPandas(emit, f"page_id {kind}, {schema}")


def runs(active: np.ndarray, least: int = 1, gap: int = 0) -> list[tuple[int, int]]:
    """Runs of true at least `least` long, then merged over gaps of up to `gap`."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], active.astype(np.int8), [0]])))
    out: list[tuple[int, int]] = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if b - a < least:
            continue
        if out and a - out[-1][1] <= gap:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def expanded(found: list[tuple[int, int]], wanted: int) -> list[tuple[int, int]]:
    """The longest run is halved, the first of equal ones, until wanted are there or none can be halved."""
    out = list(found)
    while out and len(out) < wanted:
        k = max(range(len(out)), key=lambda i: (out[i][1] - out[i][0], -i))
        a, b = out[k]
        if b - a < 2:
            break
        out[k : k + 1] = [(a, (a + b) // 2), ((a + b) // 2, b)]
    return out


def ink(img: np.ndarray, threshold: int = 210) -> np.ndarray:
    return img < threshold


def content_box(img: np.ndarray, threshold: int = 220) -> tuple[int, int, int, int]:
    """The box of ink, the whole page where there is none."""
    mask = ink(img, threshold)
    ys, xs = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    if not len(ys):
        return 0, 0, img.shape[1], img.shape[0]
    return int(xs[0]), int(ys[0]), int(xs[-1] - xs[0] + 1), int(ys[-1] - ys[0] + 1)


def rows(img: np.ndarray, threshold: int = 210) -> list[tuple[int, int, int, int]]:
    """Text rows: bands of the row projection with their extent."""
    mask = ink(img, threshold)
    h, w = mask.shape
    out = []
    for a, b in runs(mask.sum(axis=1) > max(2, 0.01 * w), 2, max(1, int(0.004 * h))):
        xs = np.flatnonzero(mask[a:b].any(axis=0))
        if len(xs) and xs[-1] - xs[0] + 1 >= 8:
            out.append((int(xs[0]), a, int(xs[-1] - xs[0] + 1), b - a))
    return out


def components(mask: np.ndarray, least: int = 20) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, area) of 8-connected parts, from runs joined row by row, in order of y, x."""
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    spans: list[tuple[int, int, int]] = []
    previous: list[int] = []
    for y in range(mask.shape[0]):
        now = []
        for a, b in runs(mask[y]):
            i = len(parent)
            parent.append(i)
            spans.append((y, a, b))
            for j in previous:
                _, c, d = spans[j]
                if c <= b and a <= d:
                    lo, hi = sorted((root(i), root(j)))
                    parent[hi] = lo
            now.append(i)
        previous = now
    box: dict[int, list[int]] = {}
    for i, (y, a, b) in enumerate(spans):
        v = box.setdefault(root(i), [a, y, b, y + 1, 0])
        v[0], v[1], v[2], v[3], v[4] = min(v[0], a), min(v[1], y), max(v[2], b), max(v[3], y + 1), v[4] + b - a
    return sorted(((x, y, x2 - x, y2 - y, n) for x, y, x2, y2, n in box.values() if n >= least), key=lambda v: (v[1], v[0]))


def horizontal_rules(img: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Long thin dark parts, opened along the row, taken together where they lie on one line."""
    h, w = img.shape
    kernel = max(40, int(0.02 * w))
    dark = np.zeros(img.shape, bool)
    for y, line in enumerate(ink(img, 180)):
        for a, b in runs(line, kernel):
            dark[y, a:b] = True
    found = [(x, y, cw, ch) for x, y, cw, ch, n in components(dark, 1) if cw >= max(40, 0.045 * w) and ch <= max(8, 0.008 * h) and n >= 0.55 * cw]
    lines: list[list[tuple[int, int, int, int]]] = []
    for r in sorted(found, key=lambda r: (r[1], r[0])):
        for group in lines:
            if abs(sum(g[1] for g in group) / len(group) - r[1]) <= 4:
                group.append(r)
                break
        else:
            lines.append([r])
    out = []
    for group in lines:
        merged: list[list[int]] = []
        for x, y, cw, ch in sorted(group):
            if merged and x - merged[-1][2] <= 0.08 * w:
                m = merged[-1]
                m[1], m[2], m[3] = min(m[1], y), max(m[2], x + cw), max(m[3], y + ch)
            else:
                merged.append([x, y, x + cw, y + ch])
        out += [(a, b, c - a, d - b) for a, b, c, d in merged]
    return sorted(out, key=lambda r: (r[1], r[0]))


def otsu(img: np.ndarray) -> int:
    """The threshold that parts dark from light best; the lowest of equal ones."""
    n = np.bincount(img.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(n), n.sum()
    mass = np.cumsum(n * np.arange(256))
    with np.errstate(invalid="ignore", divide="ignore"):
        between = (mass[-1] * below / total - mass) ** 2 / (below * (total - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def gradient(img: np.ndarray) -> np.ndarray:
    """Edges: smoothed, differentiated, above the greater of 18 and the 92nd percentile."""
    a = np.pad(img.astype(float), 2, mode="edge")
    blur = sum(k * np.roll(a, d, axis=0) for d, k in ((-1, 0.25), (0, 0.5), (1, 0.25)))
    blur = sum(k * np.roll(blur, d, axis=1) for d, k in ((-1, 0.25), (0, 0.5), (1, 0.25)))
    smooth = lambda v, axis: np.roll(v, 1, axis) + 2 * v + np.roll(v, -1, axis)
    gx = smooth(np.roll(blur, -1, 1) - np.roll(blur, 1, 1), 0)[2:-2, 2:-2]
    gy = smooth(np.roll(blur, -1, 0) - np.roll(blur, 1, 0), 1)[2:-2, 2:-2]
    size = np.hypot(gx, gy)
    return size >= max(18.0, float(np.percentile(size, 92)))


def skew(img: np.ndarray, least: int = 120) -> float:
    """Degrees of the weighted median slope of long thin dark parts; 0 where there is none."""
    found = []
    for x, y, w, h, n in components(ink(img, 180), least):
        if w < least or h > max(6, 0.12 * w):
            continue
        part = ink(img[y : y + h, x : x + w], 180)
        ys, xs = np.nonzero(part)
        mx, my = xs.mean(), ys.mean()
        spread = ((xs - mx) ** 2).sum()
        if spread:
            found.append((np.degrees(np.arctan(((xs - mx) * (ys - my)).sum() / spread)), n + w / 2))
    if not found:
        return 0.0
    found.sort()
    weights = np.cumsum([w for _, w in found])
    return float(found[int(np.searchsorted(weights, weights[-1] / 2))][0])


def footer_line(img: np.ndarray, least: float = 0.35, run: int = 90, gap: int = 25) -> float | None:
    """Degrees of the line above the footer: of the long thin parts in the page's last fifth, but for the edge, the one longest for its slope; None without one."""
    h, w = img.shape
    band = img[int(h * 0.80) : int(h * 0.98)]
    mask = np.zeros(band.shape, bool)
    for y, line in enumerate(band <= 220):
        for a, b in runs(line, run, gap):
            mask[y, a:b] = True
    best = None
    for x, y, cw, ch, _ in components(mask, 1):
        ys, xs = np.nonzero(mask[y : y + ch, x : x + cw])
        spread = ((xs - xs.mean()) ** 2).sum()
        slope = ((xs - xs.mean()) * (ys - ys.mean())).sum() / spread if spread else 0.0
        length, degrees = float(np.hypot(cw, slope * cw)), float(np.degrees(np.arctan(slope)))
        if length >= int(w * least) and (best is None or length - 12 * abs(degrees) > best[0]):
            best = (length - 12 * abs(degrees), degrees)
    return None if best is None else best[1]


def rotated(img: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """Turned about the centre on a grown canvas, bilinear."""
    h, w = img.shape
    t = np.radians(degrees)
    c, s = np.cos(t), np.sin(t)
    nh, nw = int(np.ceil(abs(h * c) + abs(w * s))), int(np.ceil(abs(h * s) + abs(w * c)))
    yy, xx = np.mgrid[0:nh, 0:nw]
    dx, dy = xx - (nw - 1) / 2, yy - (nh - 1) / 2
    sx, sy = c * dx - s * dy + (w - 1) / 2, s * dx + c * dy + (h - 1) / 2
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0

    def at(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        good = (y >= 0) & (y < h) & (x >= 0) & (x < w)
        return np.where(good, img[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)].astype(float), fill)

    top = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx
    low = at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def cropped(img: np.ndarray, x: int, y: int, w: int, h: int, pad: int = 0, fill: int = 255) -> np.ndarray:
    """The crop with a margin; what lies outside the image is filled."""
    out = np.full((h + 2 * pad, w + 2 * pad), fill, img.dtype)
    y1, x1, y2, x2 = max(0, y - pad), max(0, x - pad), min(img.shape[0], y + h + pad), min(img.shape[1], x + w + pad)
    if y2 > y1 and x2 > x1:
        out[y1 - y + pad : y2 - y + pad, x1 - x + pad : x2 - x + pad] = img[y1:y2, x1:x2]
    return out


def margins_filled(img: np.ndarray, top: int, bottom: int, left: int, right: int, fill: int = 255) -> np.ndarray:
    out = img.copy()
    h, w = img.shape
    out[: max(0, top)] = fill
    out[h - max(0, bottom) :] = fill
    out[:, : max(0, left)] = fill
    out[:, w - max(0, right) :] = fill
    return out


def page_color(img: np.ndarray, strip: int = 8) -> int:
    """The median of four inner strips."""
    parts = [img[:strip].ravel(), img[-strip:].ravel(), img[:, :strip].ravel(), img[:, -strip:].ravel()]
    return int(np.median(np.concatenate(parts)))


def stretched(img: np.ndarray, low: float = 1.0, high: float = 99.5) -> np.ndarray:
    a, b = np.percentile(img, [low, high])
    return img.copy() if b <= a else np.clip(np.rint((img - a) * 255.0 / (b - a)), 0, 255).astype(np.uint8)


def painted(img: np.ndarray, boxes: list[tuple[int, int, int, int]], fill: int = 255) -> np.ndarray:
    out = img.copy()
    for x, y, w, h in boxes:
        out[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)] = fill
    return out


def line_boxes(img: np.ndarray, wanted: int, pad: int = 4) -> list[tuple[int, int, int, int]]:
    """Boxes of the wanted number of lines: runs merged over their smallest gaps or halved; the content box for one."""
    x, y, w, h = content_box(img)
    if wanted <= 1:
        found = [(y, y + h)]
    else:
        found = runs(ink(img, 220).sum(axis=1) >= 2, 5)
        while len(found) > wanted:
            gap = min(range(1, len(found)), key=lambda i: (found[i][0] - found[i - 1][1], i))
            found[gap - 1 : gap + 1] = [(found[gap - 1][0], found[gap][1])]
        found = expanded(found or [(y, y + h)], wanted)
    H, W = img.shape
    return [(max(0, x - pad), max(0, a - pad), min(W, x + w + pad) - max(0, x - pad), min(H, b + pad) - max(0, a - pad)) for a, b in found]


def is_zero(data: Column, channels: int) -> Column:
    """Whether no colour sample of interleaved pixels is above zero; a fourth or second channel is alpha and does not count."""
    pixel = {1: "00", 2: "00..", 3: "000000", 4: "000000.."}[channels]
    return F.hex(data).rlike(f"^(?:{pixel})*$")


def mask_union(masks: DataFrame, text: str, formula: str) -> DataFrame:
    """masks with mask (text or formula, pixel by pixel), promoted_to_page (an empty text mask beside formulas becomes the whole page) and n_promoted pixels."""

    def one(texts: pd.Series, formulas: pd.Series) -> pd.DataFrame:
        rows = []
        for t, f in zip(texts, formulas):
            if t is None or f is None or len(t) != len(f):
                rows.append((None, None, None))
                continue
            a, b = np.frombuffer(t, np.uint8), np.frombuffer(f, np.uint8)
            whole = not a.any() and bool(b.any())
            out = np.full_like(a, 255) if whole else a | b
            rows.append((out.tobytes(), whole, int(((out > 0) & (a == 0)).sum())))
        return pd.DataFrame(rows, columns=["mask", "promoted_to_page", "n_promoted"])

    union = F.pandas_udf(one, "mask binary, promoted_to_page boolean, n_promoted bigint")
    return masks.withColumn("_u", union(text, formula)).select(*masks.columns, "_u.*")
