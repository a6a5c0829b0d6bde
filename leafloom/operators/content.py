"""Page content as ordered operations (page_id, ordinal, operator, x, y, w, h): scopes, state, spans, owners.

Windows pair the scopes of pages on which they nest; S.malformed tells the others, and structured() handles both with a stack, all pages of a task in one pass.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.operators import sequence as S

# Operators of content streams.
OPEN, CLOSE = {"q": "Q", "BT": "ET", "BDC": "EMC", "BMC": "EMC"}, ("Q", "ET", "EMC")
PAINT_FILL, PAINT_STROKE = ("f", "F", "f*", "B", "B*", "b", "b*"), ("S", "s")
CONSTRUCT = ("m", "l", "c", "v", "y", "h", "re")
TEXT = ("BT", "ET", "Tf", "Tm", "Td", "TD", "T*", "TL", "Tj", "TJ", "'", '"', "Tc", "Tw", "Tz", "Ts", "Tr")
PAGE = ["page_id"]


def is_in(names) -> Column:
    return F.col("operator").isin(*names)


def opens() -> Column:
    return is_in(OPEN)


def closes() -> Column:
    return is_in(CLOSE)


def depth(ops: DataFrame) -> DataFrame:
    return S.scope_depth(ops, PAGE, "ordinal", opens(), closes())


def pairs(ops: DataFrame, opener: str, closer: str) -> DataFrame:
    """(page_id, opened, closed) of one kind of scope."""
    return S.scope_pairs(ops, PAGE, "ordinal", F.col("operator") == opener, F.col("operator") == closer).select("page_id", "opened", "closed")


def structured(ops: DataFrame) -> DataFrame:
    """(page_id, ordinal, depth, parent, problem) by a stack: only the top's own closer pops, others stay with a diagnosis.

    The window brings each page's rows one after the other, in order, and tells its first; so one pass takes all pages of a
    task. Batches wait for as long as they hold a scope that may be left open.
    """
    kinds = {c: k + 1 for k, c in enumerate(CLOSE)}
    code = F.lit(0)
    for op, kind in [*((o, kinds[c]) for o, c in OPEN.items()), *((c, -k) for c, k in kinds.items())]:
        code = F.when(F.col("operator") == op, kind).otherwise(code)
    none = np.iinfo(np.int64).min
    problems = pa.array([None, "unmatched_scope_close", "unclosed_scope"])

    def finished(batch: pa.RecordBatch, depth: np.ndarray, parent: np.ndarray, problem: np.ndarray) -> pa.RecordBatch:
        columns = [batch["page_id"], batch["ordinal"], pa.array(depth), pa.array(parent, mask=parent == none), problems.take(pa.array(problem))]
        return pa.RecordBatch.from_arrays(columns, names=["page_id", "ordinal", "depth", "parent", "problem"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[int, int, np.ndarray, int, int]] = []  # ordinal, kind, problems of the batch, place in it, number of the batch
        waiting: deque[tuple] = deque()

        def leave() -> None:
            for _, _, found, place, _ in stack:
                found[place] = 2
            stack.clear()

        for number, batch in enumerate(batches):
            n = batch.num_rows
            codes, firsts = batch["code"].to_numpy(), batch["first"].to_numpy(zero_copy_only=False)
            at = np.flatnonzero((codes != 0) | firsts)
            problem = np.zeros(n, np.int8)
            ordinals = batch["ordinal"].fill_null(none).to_numpy()[at].tolist()
            depths, parents = [], []  # of the rows at
            after_depths, after_parents = [len(stack)], [stack[-1][0] if stack else none]  # of the rows that follow each
            for place, kind, first, ordinal in zip(at.tolist(), codes[at].tolist(), firsts[at].tolist(), ordinals):
                if first:
                    leave()
                if kind < 0 and stack and stack[-1][1] == -kind:
                    depths.append(len(stack))
                    parents.append(stack.pop()[0])
                else:
                    depths.append(len(stack))
                    parents.append(stack[-1][0] if stack else none)
                    if kind < 0:
                        problem[place] = 1
                    elif kind:
                        stack.append((ordinal, kind, problem, place, number))
                after_depths.append(len(stack))
                after_parents.append(stack[-1][0] if stack else none)
            rows = np.diff(np.concatenate(([0], at, [n])))
            depth, parent = np.repeat(np.array(after_depths, np.int64), rows), np.repeat(np.array(after_parents, np.int64), rows)
            depth[at], parent[at] = depths, parents
            waiting.append((number, batch, depth, parent, problem))
            while waiting and (not stack or waiting[0][0] < stack[0][4]):
                yield finished(*waiting.popleft()[1:])
        leave()
        for _, *rest in waiting:
            yield finished(*rest)

    turn = F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("ordinal").asc_nulls_last()))
    rows = ops.select(*[F.col(c).cast("bigint").alias(c) for c in ("page_id", "ordinal")], code.alias("code"), (turn == 1).alias("first"))
    return rows.mapInArrow(walk, "page_id bigint, ordinal bigint, depth bigint, parent bigint, problem string")


def _upto(order: str = "ordinal") -> Window:
    return Window.partitionBy("page_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def _after(order: str = "ordinal") -> Window:
    return Window.partitionBy("page_id").orderBy(order).rowsBetween(0, Window.unboundedFollowing)


def last_of(names, value: Column | str = "ordinal", window=None) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.last(F.when(is_in(names), v), ignorenulls=True).over(window if window is not None else _upto())


def next_of(names, value: str = "ordinal") -> Column:
    return F.first(F.when(is_in(names), F.col(value)), ignorenulls=True).over(_after())


def font_state(ops: DataFrame) -> DataFrame:
    """The font size in force before each operation; it outlives the text block that set it."""
    before = Window.partitionBy("page_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return ops.withColumn("font_size", last_of(["Tf"], "w", before))


def text_candidates(ops: DataFrame, page_height: float = 800.0) -> DataFrame:
    """Shown text inside a block that has set its matrix: box from the font size, y from the top."""
    s = ops.withColumn("fs", last_of(["Tf"], "w")).withColumn("bt", last_of(["BT"])).withColumn("et", last_of(["ET"])).withColumn("tm", last_of(["Tm"]))
    s = s.withColumn("tx", last_of(["Tm"], "x")).withColumn("ty", last_of(["Tm"], "y"))
    t = s.where(is_in(["Tj", "TJ"]) & (F.col("tm") > F.col("bt")) & (F.coalesce("et", F.lit(-1)) < F.col("bt")))
    w = F.greatest(0.5 * F.col("fs"), F.lit(5) * 0.5 * F.col("fs"))
    return t.select("page_id", "ordinal", F.col("tx").alias("x"), (page_height - F.col("ty") - F.col("fs")).alias("y"), w.alias("w"), F.col("fs").alias("h"))


def text_spans(ops: DataFrame) -> DataFrame:
    """(page_id, ordinal, start, stop): from a shown text back to its BT, or to the q before that with nothing but state between, on to the ET, and over a Q behind it.

    Where a block starts and stops is worked out at its BT and ET and carried from there, so one partitioning serves all.
    """
    before = F.last(F.when(is_in(["q", "Q", "BT", "ET", "BDC", "EMC"]), F.struct("ordinal", "operator")), True).over(Window.partitionBy("page_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    follow = F.lead("operator").over(Window.partitionBy("page_id").orderBy("ordinal"))
    s = ops.select("page_id", "ordinal", "operator").withColumn("before", before).withColumn("follow", follow)
    start = F.when(F.col("before.operator") == "q", F.col("before.ordinal")).otherwise(F.col("ordinal"))
    s = s.withColumn("at_start", F.when(F.col("operator") == "BT", start)).withColumn("at_stop", F.when(F.col("operator") == "ET", F.col("ordinal") + F.when(F.col("follow") == "Q", 1).otherwise(0)))
    s = s.withColumn("start", F.last("at_start", True).over(_upto())).withColumn("stop", F.first("at_stop", True).over(_after()))
    return s.where(is_in(["Tj", "TJ"]) & F.col("start").isNotNull() & F.col("stop").isNotNull()).select("page_id", "ordinal", "start", "stop")


def marked_blocks(ops: DataFrame) -> DataFrame:
    """(page_id, start, stop, x, y, x2, y2): marked content with path geometry; a nested opener starts anew."""
    s = ops.withColumn("start", last_of(["BDC"])).withColumn("stop", next_of(["EMC"])).withColumn("closed", last_of(["EMC"]))
    inside = s.where((F.col("start").isNotNull()) & (F.col("ordinal") <= F.col("stop")) & (F.coalesce("closed", F.lit(-1)) < F.col("start")) | (F.col("operator") == "EMC"))
    path = is_in(["m", "l", "c", "h"])
    point = lambda f, c: f(F.when(is_in(["m", "l", "c"]), F.col(c)))
    g = inside.groupBy("page_id", "start").agg(F.max("stop").alias("stop"), F.bool_or(path).alias("path"), point(F.min, "x").alias("x"), point(F.min, "y").alias("y"), point(F.max, "x").alias("x2"), point(F.max, "y").alias("y2"))
    return g.where("path and x is not null").drop("path")


def clusters(blocks: DataFrame, most: int = 8) -> DataFrame:
    """Blocks at most `most` places apart, taken together where there are at least two."""
    w = Window.partitionBy("page_id").orderBy("start")
    near = S.island_ids(blocks.withColumn("gap", F.col("start") - F.lag("stop").over(w)), PAGE, ["start"], F.coalesce(F.col("gap") > most, F.lit(True)), "cluster")
    g = near.groupBy("page_id", "cluster").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("n"))
    return g.where("n >= 2").drop("cluster")


POINTS = ("m", "l", "c", "v", "y", "re")
KEEP_PATH = ("q", "Q", "W", "W*", "Do", "sh")


def visual_spans(ops: DataFrame, owned: Column | None = None) -> DataFrame:
    """(page_id, kind, first, last, n, ..., owned): text from BT to ET, paths that are painted, and single painters.

    A path begins anew at any operator but the state ones; what is not painted before that, and text without an end, is none.
    owned: whether an operation has an owner; a span is owned where all its operations are.
    """
    upto, before = _upto(), Window.partitionBy("page_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    bt = F.last(F.when(F.col("operator") == "BT", F.col("ordinal")), True).over(upto)
    et = F.last(F.when(F.col("operator") == "ET", F.col("ordinal")), True).over(before)
    s = ops.withColumn("has_owner", F.lit(False) if owned is None else owned).withColumn("bt", bt).withColumn("et", et)
    s = s.withColumn("in_text", F.coalesce(F.col("bt") > F.coalesce("et", F.lit(-1)), F.lit(False)))
    paint = is_in([*PAINT_FILL, *PAINT_STROKE])
    cuts = (F.col("in_text") & (F.col("operator") == "BT")) | (~F.col("in_text") & ~is_in([*CONSTRUCT, *KEEP_PATH]))
    s = s.withColumn("part", F.coalesce(F.sum(F.when(cuts, 1).otherwise(0)).over(before), F.lit(0)))
    kind = F.when(F.col("in_text"), "text_span").when(is_in(CONSTRUCT) | paint, "path_span").when(F.col("operator") == "Do", "image_operation").when(F.col("operator") == "sh", "shading_operation")
    span = F.when(F.col("in_text"), F.col("bt")).when(is_in(["Do", "sh"]), F.col("ordinal")).otherwise(F.col("part"))
    s = s.withColumn("kind", kind).where("kind is not null").withColumn("span", span)
    point, rect = is_in(POINTS), F.col("operator") == "re"
    edge = lambda f, c, size: f(F.when(point, F.col(c) + F.when(rect, F.col(size)).otherwise(0.0)))
    low = lambda c, size: F.least(F.min(F.when(point, F.col(c))), edge(F.min, c, size))
    high = lambda c, size: F.greatest(F.max(F.when(point, F.col(c))), edge(F.max, c, size))
    g = s.groupBy("page_id", "kind", "span").agg(
        F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count("*").alias("n"), F.max_by("operator", "ordinal").alias("painter"), F.count_if(is_in(CONSTRUCT)).alias("n_construct"),
        F.count_if(is_in(["m", "l", "c", "v", "y"])).alias("n_lines"), (high("x", "w") - low("x", "w")).alias("width"), (high("y", "h") - low("y", "h")).alias("height"), F.bool_and("has_owner").alias("owned"),
    )
    painted = F.col("painter").isin(*PAINT_FILL, *PAINT_STROKE) & (F.col("n_construct") > 0)
    return g.where(F.when(F.col("kind") == "text_span", F.col("painter") == "ET").when(F.col("kind") == "path_span", painted).otherwise(F.lit(True))).drop("span")


def classify(spans: DataFrame, thin_length: float = 6.0, thin_width: float = 2.5) -> DataFrame:
    """What an unowned span may be."""
    stroke = F.col("painter").isin(*PAINT_STROKE)
    c = F.when(F.col("kind") == "text_span", "text_content_candidate").when(F.col("kind") == "image_operation", "embedded_image_candidate").when(F.col("kind") == "shading_operation", "shading_candidate")
    c = c.when(stroke & (F.col("n_lines") <= 2), "radical_or_geometry_stroke_candidate").when(stroke, "geometry_stroke_candidate")
    thin = (F.greatest("width", "height") >= thin_length) & (F.least("width", "height") <= thin_width)
    return spans.withColumn("class", c.when(thin, "thin_rule_or_fraction_bar_candidate").otherwise("filled_geometry_candidate"))


def local(ops: DataFrame, owned: DataFrame) -> DataFrame:
    """Operands moved to their group's top left: y from the group's top, downwards. owned: page_id, ordinal, gx, gy, gh."""
    j = ops.join(owned, ["page_id", "ordinal"])
    top = F.col("gy") + F.col("gh")
    height = F.when(F.col("operator") == "re", F.col("h")).otherwise(F.lit(0.0))
    moves = is_in(["m", "l", "Tm", "re", "c"])
    return j.withColumn("lx", F.when(moves, F.col("x") - F.col("gx"))).withColumn("ly", F.when(moves, top - F.col("y") - height))


def ownership(groups: DataFrame, group_ops: DataFrame, ops: DataFrame) -> DataFrame:
    """(page_id, problem, n): owned ordinals that do not exist or have several owners, tables without children, ordinals out of order."""
    missing = group_ops.join(ops.select("page_id", "ordinal"), ["page_id", "ordinal"], "left_anti").groupBy("page_id").agg(F.count("*").alias("n")).withColumn("problem", F.lit("missing_operation"))
    twice = group_ops.groupBy("page_id", "ordinal").agg(F.countDistinct("group_id").alias("k")).where("k > 1").groupBy("page_id").agg(F.count("*").alias("n")).withColumn("problem", F.lit("several_owners"))
    kids = groups.select("page_id", F.col("parent_id").alias("group_id")).distinct()
    empty = groups.where("kind = 'table'").join(kids, ["page_id", "group_id"], "left_anti").groupBy("page_id").agg(F.count("*").alias("n")).withColumn("problem", F.lit("empty_table"))
    again = ops.groupBy("page_id", "ordinal").count().where("count > 1").groupBy("page_id").agg(F.count("*").alias("n")).withColumn("problem", F.lit("repeated_ordinal"))
    return missing.unionByName(twice).unionByName(empty).unionByName(again)


def serialized(ops: DataFrame) -> DataFrame:
    """(page_id, stream): the operations as text in order."""
    row = F.concat_ws(" ", F.when(is_in(["re"]), F.format_string("%.1f %.1f %.1f %.1f", "x", "y", "w", "h")).when(is_in(["m", "l"]), F.format_string("%.1f %.1f", "x", "y")), "operator")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", row.alias("row")))), lambda s: s["row"])
    return ops.groupBy("page_id").agg(F.array_join(parts, "\n").alias("stream"))


def contexts(paths: DataFrame) -> DataFrame:
    """(page_id, ordinal, step, event, group_id) for paths(page_id, ordinal, path): contexts closed and opened before each operation.

    The owner path of the previous operation is closed down to the common beginning, then the rest of the new one is opened.
    """
    w = Window.partitionBy("page_id").orderBy("ordinal")
    p = paths.withColumn("was", F.coalesce(F.lag("path").over(w), F.array().cast("array<string>")))
    both = F.least(F.size("path"), F.size("was"))
    same = F.aggregate(F.sequence(F.lit(0), F.greatest(both, F.lit(1)) - 1), F.lit(0), lambda a, i: F.when((a == i) & (i < both) & (F.get("path", i) == F.get("was", i)), a + 1).otherwise(a))
    p = p.withColumn("same", same)
    leave = F.transform(F.reverse(F.slice("was", F.col("same") + 1, F.greatest(F.size("was") - F.col("same"), F.lit(0)))), lambda g: F.struct(F.lit("leave").alias("event"), g.alias("group_id")))
    enter = F.transform(F.slice("path", F.col("same") + 1, F.greatest(F.size("path") - F.col("same"), F.lit(0))), lambda g: F.struct(F.lit("enter").alias("event"), g.alias("group_id")))
    return p.select("page_id", "ordinal", F.posexplode(F.concat(leave, enter)).alias("step", "e")).select("page_id", "ordinal", F.col("step").cast("bigint").alias("step"), "e.event", "e.group_id")
