"""Registered transforms on page tables and the runner of declarative chains.

A document is a dict of DataFrames, keyed by page_id throughout:
  ops        page_id, ordinal, operator, x, y, w, h, k
  nodes      page_id, node_id, node_no, type, x, y, w, h, text, b
  groups     page_id, group_id, parent_id, kind, x, y, w, h
  group_ops  page_id, group_id, ordinal
  structure  page_id, node_id, parent_id, role, mcid
Every transform returns a new dict; tables it does not touch are passed on. A stage is a lazy plan; run() writes the
ownership tables that a stage made anew once, as later stages read them several times. check() gives the contract's
violations of the end result as one more table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.operators import content as C
from leafloom.operators import match
from leafloom.operators import tree as R
from leafloom.session import materialize
from leafloom.sources.manifests import ManifestError, stages

Tables = dict[str, DataFrame]
Transform = Callable[[Tables, dict], Tables]
REGISTRY: dict[str, Transform] = {}
GROUP_COLUMNS = ["page_id", "group_id", "parent_id", "kind", "x", "y", "w", "h"]


def register(name: str) -> Callable[[Transform], Transform]:
    def add(f: Transform) -> Transform:
        if name in REGISTRY:
            raise ManifestError(f"{name} is registered twice")
        REGISTRY[name] = f
        return f

    return add


def resolve(name: str) -> Transform:
    if name not in REGISTRY:
        raise ManifestError(f"unknown transform {name!r}")
    return REGISTRY[name]


def run(tables: Tables, manifest: dict) -> Tables:
    """The manifest's transforms in its order; none is added, left out or moved."""

    def stage(t: Tables, s: tuple[str, dict]) -> Tables:
        out = resolve(s[0])(t, s[1])
        return out | {k: materialize(out[k], k) for k in ("groups", "group_ops") if k in out and out[k] is not t.get(k)}

    return reduce(stage, stages(manifest), dict(tables))


def check(tables: Tables) -> DataFrame:
    """(page_id, problem, n); empty when the ownership contract holds."""
    return C.ownership(tables["groups"], tables["group_ops"], tables["ops"])


def _id(prefix: str, *parts: str) -> Column:
    return F.concat_ws("-", F.lit(prefix), *[F.col(p).cast("string") for p in parts])


def _add(tables: Tables, groups: DataFrame | None = None, claims: DataFrame | None = None) -> Tables:
    out = dict(tables)
    if groups is not None:
        new = groups.select(*GROUP_COLUMNS)
        out["groups"] = tables["groups"].select(*GROUP_COLUMNS).unionByName(new) if "groups" in tables else new
    if claims is not None:
        new = claims.select("page_id", "group_id", "ordinal")
        if "group_ops" in tables:  # a new claim takes the operation from its former owner
            new = tables["group_ops"].join(new.select("page_id", "ordinal"), ["page_id", "ordinal"], "left_anti").select("page_id", "group_id", "ordinal").unionByName(new)
        out["group_ops"] = new
    return out


@register("identity.v1")
def identity(tables: Tables, options: dict) -> Tables:
    return {k: v.select("*") for k, v in tables.items()}


@register("project.pdf-ir.v1")
def project(tables: Tables, options: dict) -> Tables:
    """Operations are kept, nodes start empty; a page box needs four numbers and an extent."""
    out = dict(tables)
    if "pages" in tables:
        m = F.col("media_box")
        out["pages"] = tables["pages"].where((F.size(m) == 4) & (F.get(m, F.lit(2)) > F.get(m, F.lit(0))) & (F.get(m, F.lit(3)) > F.get(m, F.lit(1))))
    if "nodes" in tables:
        out["nodes"] = tables["nodes"].where("false")
    return out


@register("font.catalog.v1")
def fonts(tables: Tables, options: dict) -> Tables:
    """Use of each font; resource_mapping renames sizes' resources (old to new)."""
    out = dict(tables)
    mapping = {float(k): float(v) for k, v in (options.get("resource_mapping") or {}).items()}
    if mapping:
        pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
        out["ops"] = tables["ops"].withColumn("w", F.when(F.col("operator") == "Tf", F.coalesce(F.try_element_at(pairs, F.col("w")), F.col("w"))).otherwise(F.col("w")))
    used = out["ops"].where("operator = 'Tf'").groupBy(F.col("w").alias("font"))
    out["fonts"] = used.agg(F.count("*").alias("n_used"), F.countDistinct("page_id").alias("n_pages"), F.min("page_id").alias("first_page"))
    return out


@register("group.horizontal-rules.v1")
def rule_sections(tables: Tables, options: dict) -> Tables:
    """Sections between full-width rules: a node belongs to the last rule at or above its centre."""
    n = tables["nodes"]
    rule = F.expr(f"type = 'rule' and w >= {float(options.get('aspect', 20))} * h")
    rules = n.where(rule).groupBy("page_id", F.col("y").cast("double").alias("at")).agg(F.max("node_id").alias("section"))
    rows = n.where(~rule).select("page_id", (F.col("y") + F.col("h") / 2).alias("at"), "node_id", "x", "y", "w", "h")
    placed = match.as_of(rows, rules, ["page_id"], "at", "section").withColumn("section", F.coalesce("section", F.lit("top")))
    g = placed.groupBy("page_id", "section").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"))
    sections = g.select("page_id", _id("section", "page_id", "section").alias("group_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("section").alias("kind"), *[F.expr(e).cast("double").alias(c) for c, e in (("x", "x"), ("y", "y"), ("w", "x2 - x"), ("h", "y2 - y"))])
    out = _add(tables, sections)
    out["node_sections"] = placed.select("page_id", "node_id", _id("section", "page_id", "section").alias("group_id"))
    return out


@register("geometry.operations-into-groups.v1")
def operation_groups(tables: Tables, options: dict) -> Tables:
    """Clusters of marked paths own the operations of their blocks, sparse as these are."""
    blocks = C.marked_blocks(tables["ops"])
    c = C.clusters(blocks, int(options.get("gap", 8)))
    g = c.select("page_id", _id("geometry", "page_id", "start").alias("group_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("group").alias("kind"), "x", "y", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"), "start", "stop")
    spans = g.select("page_id", "group_id", F.col("start").alias("from"), F.col("stop").alias("to"))
    own = match.candidates(blocks.select("page_id", "start", "stop"), spans, ["page_id"], F.expr("start >= from and stop <= to"))
    return _add(tables, g, own.select("page_id", "group_id", F.explode(F.sequence("start", "stop")).alias("ordinal")))


@register("layout.associate-text-operations.v1")
def associate_text(tables: Tables, options: dict) -> Tables:
    """Shown text goes to the smallest group whose widened box holds it; its whole span moves to a new child."""
    span = {"left": 24, "right": 24, "top": 10, "bottom": 10} | (options.get("collision_span") or {})
    ops = tables["ops"]
    t = C.text_candidates(ops, 0.0).select("page_id", "ordinal", F.col("x").alias("tx"), (-F.col("y") - F.col("h")).alias("ty"), F.col("w").alias("tw"), F.col("h").alias("th"))
    g = tables["groups"].where("kind = 'group'").select("page_id", F.col("group_id").alias("owner"), "x", "y", "w", "h")
    inside = F.expr(f"tx >= x - {span['left']} and ty >= y - {span['bottom']} and tx + tw <= x + w + {span['right']} and ty + th <= y + h + {span['top']}")
    won = match.best(match.candidates(t, g, ["page_id"], inside), ["page_id", "ordinal"], F.expr("w * h"), "owner")
    child = won.select("page_id", F.concat("owner", F.lit("-text-"), F.col("ordinal").cast("string")).alias("group_id"), F.col("owner").alias("parent_id"), F.lit("text_operations").alias("kind"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tw").alias("w"), F.col("th").alias("h"), "ordinal")
    spans = C.text_spans(ops)
    claims = child.join(spans, ["page_id", "ordinal"]).select("page_id", "group_id", F.explode(F.sequence("start", "stop")).alias("ordinal")).dropDuplicates(["page_id", "ordinal"])
    return _add(tables, child, claims)


def _pathed(tables: Tables) -> DataFrame:
    return R.paths(tables["groups"], "group_id", "parent_id", ["page_id"])


def _grown(tables: Tables) -> DataFrame:
    """(page_id, group_id, gx, gy, gx2, gy2): each group's box with its whole subtree."""
    return R.subtree(_pathed(tables), "group_id", ["page_id"], F.min("x").alias("gx"), F.min("y").alias("gy"), F.max(F.col("x") + F.col("w")).alias("gx2"), F.max(F.col("y") + F.col("h")).alias("gy2"))


@register("layout.expand-associated-content.v1")
def expand_content(tables: Tables, options: dict) -> Tables:
    """A wrapper round each root group that has text below it; the root becomes its child."""
    g = tables["groups"]
    with_text = g.where("kind = 'text_operations'").select("page_id", F.col("parent_id").alias("group_id")).distinct()
    roots = g.where("parent_id is null").join(with_text, ["page_id", "group_id"], "left_semi").join(_grown(tables), ["page_id", "group_id"])
    wrap = roots.select("page_id", F.concat("group_id", F.lit("-wrapper")).alias("group_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("content_group").alias("kind"), F.col("gx").alias("x"), F.col("gy").alias("y"), (F.col("gx2") - F.col("gx")).alias("w"), (F.col("gy2") - F.col("gy")).alias("h"), F.col("group_id").alias("inner_id"))
    moved = g.join(wrap.select("page_id", F.col("inner_id").alias("group_id"), F.col("group_id").alias("up")), ["page_id", "group_id"], "left").withColumn("parent_id", F.coalesce("parent_id", "up")).select(*GROUP_COLUMNS)
    return {**tables, "groups": moved.unionByName(wrap.select(*GROUP_COLUMNS))}


@register("layout.promote-content-groups-to-one-cell-tables.v1")
def one_cell_tables(tables: Tables, options: dict) -> Tables:
    """Each content group becomes a table whose one cell takes its children and operations."""
    g = tables["groups"]
    cell = F.concat("group_id", F.lit("::cell"))
    content = g.where("kind = 'content_group'")
    cells = content.withColumn("parent_id", F.col("group_id")).withColumn("group_id", cell).withColumn("kind", F.lit("cell"))
    ids = content.select("page_id", F.col("group_id").alias("table_id"))
    kids = g.join(ids.select("page_id", F.col("table_id").alias("parent_id"), F.lit(True).alias("inside")), ["page_id", "parent_id"], "left").withColumn("parent_id", F.when(F.col("inside"), F.concat("parent_id", F.lit("::cell"))).otherwise(F.col("parent_id"))).withColumn("kind", F.when(F.col("kind") == "content_group", "table").otherwise(F.col("kind")))
    owned = tables["group_ops"].join(ids.select("page_id", F.col("table_id").alias("group_id"), F.lit(True).alias("inside")), ["page_id", "group_id"], "left").withColumn("group_id", F.when(F.col("inside"), cell).otherwise(F.col("group_id")))
    return {**tables, "groups": kids.select(*GROUP_COLUMNS).unionByName(cells.select(*GROUP_COLUMNS)), "group_ops": owned.select("page_id", "group_id", "ordinal")}


@register("evaluation.inject-six-lines-into-first-cell.v1")
def inject_lines(tables: Tables, options: dict) -> Tables:
    """Five operations for each line behind the page's last, 14 points apart, owned by the page's first cell."""
    lines = list(options.get("lines") or [f"line {i + 1}" for i in range(6)])
    first = match.best(tables["groups"].where("kind = 'cell'"), ["page_id"], "group_id").select("page_id", "group_id", "x", "y")
    if options.get("page_id") is not None:
        first = first.where(F.col("page_id") == F.lit(options["page_id"]))
    last = tables["ops"].groupBy("page_id").agg(F.max("ordinal").alias("last"), F.max("k").alias("last_k"))
    row = F.explode(F.array(*[F.struct(F.lit(5 * i + j).alias("n"), F.lit(op).alias("operator"), F.lit(i).alias("line")) for i in range(len(lines)) for j, op in enumerate(("BT", "Tf", "Tm", "Tj", "ET"))]))
    new = first.join(last, "page_id").withColumn("r", row).select("page_id", "group_id", (F.col("last") + 1 + F.col("r.n")).alias("ordinal"), "r.operator", "x", (F.col("y") - 14.0 * F.col("r.line")).alias("y"), F.lit(10.0).alias("w"), F.lit(1.0).alias("h"), (F.col("last_k") + 1 + F.col("r.line")).alias("k"))
    ops = tables["ops"].unionByName(new.select(*tables["ops"].columns))
    return {**tables, "ops": ops, "group_ops": tables["group_ops"].unionByName(new.select("page_id", "group_id", "ordinal"))}


@register("layout.intrinsic-container-growth.v1")
def growth(tables: Tables, options: dict) -> Tables:
    """Tables and cells grow to hold what is in them; overflow 'visible' keeps boxes, 'reject' raises on the first that would grow."""
    pad, overflow = float(options.get("padding", 0)), options.get("overflow", "grow")
    if overflow == "visible":
        return dict(tables)
    j = tables["groups"].join(_grown(tables), ["page_id", "group_id"])
    box = F.col("kind").isin("table", "cell")
    grows = box & F.expr("gx < x or gy < y or gx2 > x + w or gy2 > y + h")
    if overflow == "reject":
        j = j.withColumn("kind", F.when(grows, F.raise_error(F.concat(F.lit("overflow in "), F.col("group_id")))).otherwise(F.col("kind")))
        return {**tables, "groups": j.select(*GROUP_COLUMNS)}
    new = {"x": F.col("gx") - pad, "y": F.col("gy") - pad, "w": F.col("gx2") - F.col("gx") + 2 * pad, "h": F.col("gy2") - F.col("gy") + 2 * pad}
    return {**tables, "groups": j.select("page_id", "group_id", "parent_id", "kind", *[F.when(grows, e).otherwise(F.col(c)).alias(c) for c, e in new.items()])}


@register("layout.materialize-operation-tree.v1")
def operation_tree(tables: Tables, options: dict) -> Tables:
    """tree: page_id, node, kind, first ordinal, position; operations that nobody owns are leaves of their own."""
    g = _pathed(tables).select("page_id", "group_id", F.explode("path").alias("node"))
    first = tables["group_ops"].join(g, ["page_id", "group_id"]).groupBy("page_id", "node").agg(F.min("ordinal").alias("first")).withColumn("kind", F.lit("operation_group"))
    loose = tables["ops"].select("page_id", "ordinal").join(tables["group_ops"], ["page_id", "ordinal"], "left_anti").select("page_id", F.concat(F.lit("op-"), F.col("ordinal").cast("string")).alias("node"), F.col("ordinal").alias("first"), F.lit("operation").alias("kind"))
    w = Window.partitionBy("page_id").orderBy("first", F.desc("kind"), "node")
    return {**tables, "tree": first.unionByName(loose).withColumn("position", F.row_number().over(w).cast("bigint"))}


@register("geometry.move-groups-to-parent-origin.v1")
def to_parent_origin(tables: Tables, options: dict) -> Tables:
    """Named groups (all, if none is named) move to their parent's origin, and their text and rectangle operands with them, once."""
    g = tables["groups"]
    p = g.select("page_id", F.col("group_id").alias("parent_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    named = options.get("group_ids")
    moved = g.join(p, ["page_id", "parent_id"])
    moved = moved.where(F.col("group_id").isin(*named)) if named else moved
    shift = moved.select("page_id", "group_id", (F.col("px") - F.col("x")).alias("dx"), (F.col("py") - F.col("y")).alias("dy"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    groups = g.join(shift, ["page_id", "group_id"], "left").withColumn("x", F.col("x") + zero("dx")).withColumn("y", F.col("y") + zero("dy")).select(*GROUP_COLUMNS)
    by_op = tables["group_ops"].join(shift, ["page_id", "group_id"]).dropDuplicates(["page_id", "ordinal"]).select("page_id", "ordinal", "dx", "dy")
    moves = F.col("operator").isin("Tm", "re")
    j = tables["ops"].join(by_op, ["page_id", "ordinal"], "left")
    ops = j.withColumn("x", F.when(moves, F.col("x") + zero("dx")).otherwise(F.col("x"))).withColumn("y", F.when(moves, F.col("y") + zero("dy")).otherwise(F.col("y"))).select(*tables["ops"].columns)
    return {**tables, "groups": groups, "ops": ops}


@register("geometry.localize-operation-groups.v1")
def localize(tables: Tables, options: dict) -> Tables:
    """local_ops: owned operations with operands from their group's top left; the originals stay in ops."""
    own = tables["group_ops"].join(tables["groups"].select("page_id", "group_id", F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("h").alias("gh")), ["page_id", "group_id"])
    return {**tables, "local_ops": C.local(tables["ops"], own.dropDuplicates(["page_id", "ordinal"]))}


@register("layout.relative-coordinates.v1")
def relative(tables: Tables, options: dict) -> Tables:
    """relative: each group's box from its parent's origin and from the sibling before it."""
    g = tables["groups"]
    p = g.select("page_id", F.col("group_id").alias("parent_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    j = g.join(p, ["page_id", "parent_id"], "left").withColumn("rx", F.col("x") - F.coalesce("px", F.lit(0.0))).withColumn("ry", F.col("y") - F.coalesce("py", F.lit(0.0)))
    return {**tables, "relative": R.siblings(j, ["page_id"], "parent_id", "group_id", F.col("x").isNotNull(), "x", "y").select("page_id", "group_id", "rx", "ry", "dx", "dy")}


@register("debug.visualize-groups.v1")
def visualize(tables: Tables, options: dict) -> Tables:
    """overlays: a shade of grey that darkens with depth."""
    d = _pathed(tables)
    return {**tables, "overlays": d.select("page_id", "group_id", "depth", F.greatest(F.lit(0.75), 0.96 - 0.06 * F.col("depth")).alias("fill_gray"))}


@register("structure.materialize-native-tables.v1")
def native_tables(tables: Tables, options: dict) -> Tables:
    """Table, row and cell elements become groups that own their marked content directly; the structure is used up."""
    roles = F.create_map(*[F.lit(x) for kv in {"/Table": "table", "/TR": "row", "/TH": "cell", "/TD": "cell"}.items() for x in kv])
    s = tables["structure"].withColumn("kind", F.try_element_at(roles, F.col("role"))).where("kind is not null")
    ranges = C.pairs(tables["ops"], "BDC", "EMC").select("page_id", F.col("opened").alias("mcid"), "opened", "closed")
    own = s.join(ranges, ["page_id", "mcid"]).select("page_id", F.col("node_id").alias("group_id"), F.explode(F.sequence("opened", "closed")).alias("ordinal"))
    boxes = own.join(tables["ops"].where("operator in ('m', 'l', 're')"), ["page_id", "ordinal"]).groupBy("page_id", "group_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("x2"), F.max("y").alias("y2"))
    g = s.select("page_id", F.col("node_id").alias("group_id"), "parent_id", "kind").join(boxes, ["page_id", "group_id"], "left").select("page_id", "group_id", "parent_id", "kind", "x", "y", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"))
    out = _add(tables, g, own.dropDuplicates(["page_id", "ordinal"]))
    out.pop("structure")
    return out


@register("diagnostics.unprocessed-items.v1")
def unprocessed(tables: Tables, options: dict) -> Tables:
    """unprocessed: visual spans not all of whose operations have an owner, by class."""
    owned = tables["group_ops"].select("page_id", "ordinal", F.lit(True).alias("claimed")).distinct()
    marked = tables["ops"].join(owned, ["page_id", "ordinal"], "left")
    spans = C.visual_spans(marked, F.coalesce("claimed", F.lit(False))).where("not owned")
    left = C.classify(spans, float(options.get("thin_rule_min_length", 6.0)), float(options.get("thin_rule_max_thickness", 2.5)))
    return {**tables, "unprocessed": left if options.get("include_text", True) else left.where("kind <> 'text_span'")}


@register("translation.project.v1")
def translation(tables: Tables, options: dict) -> Tables:
    """units: the page's texts in reading order with stable ids, for a target language."""
    n = tables["nodes"].where(F.col("type").isin("text_band", "text_fragment", "heading", "caption") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    pos = F.row_number().over(Window.partitionBy("page_id").orderBy("y", "node_no"))
    units = n.withColumn("pos", pos).select("page_id", F.format_string("%s-text-%05d", "page_id", "pos").alias("unit_id"), "pos", "node_id", "text", F.lit(options.get("target_language")).cast("string").alias("target_language"))
    return {**tables, "units": units}


@register("translation.validate.v1")
def validate_translation(tables: Tables, options: dict) -> Tables:
    """unit_problems: repeated ids, empty texts, units of nodes that do not exist."""
    u = tables["units"]
    again = u.groupBy("unit_id").count().where("count > 1").select("unit_id", F.lit("repeated_id").alias("problem"))
    empty = u.where(F.trim("text") == "").select("unit_id", F.lit("empty_text").alias("problem"))
    lost = u.join(tables["nodes"].select("node_id").distinct(), "node_id", "left_anti").select("unit_id", F.lit("missing_node").alias("problem"))
    return {**tables, "unit_problems": again.unionByName(empty).unionByName(lost)}


CHAINS = {
    "empty": [],
    "identity": ["identity.v1"],
    "projection": ["project.pdf-ir.v1"],
    "diagnostics": ["geometry.operations-into-groups.v1", "diagnostics.unprocessed-items.v1"],
    "relative": ["font.catalog.v1", "group.horizontal-rules.v1", "geometry.operations-into-groups.v1", "layout.associate-text-operations.v1", "layout.expand-associated-content.v1", "geometry.localize-operation-groups.v1", "layout.relative-coordinates.v1"],
    "debug": ["group.horizontal-rules.v1", "geometry.operations-into-groups.v1", "layout.associate-text-operations.v1", "layout.expand-associated-content.v1", "layout.relative-coordinates.v1", "debug.visualize-groups.v1", "layout.materialize-operation-tree.v1"],
    "growth": ["geometry.operations-into-groups.v1", "layout.associate-text-operations.v1", "layout.expand-associated-content.v1", "layout.promote-content-groups-to-one-cell-tables.v1", "evaluation.inject-six-lines-into-first-cell.v1", "layout.intrinsic-container-growth.v1", "layout.relative-coordinates.v1", "layout.materialize-operation-tree.v1"],
    "translation": ["font.catalog.v1", "group.horizontal-rules.v1", "geometry.operations-into-groups.v1", "layout.associate-text-operations.v1", "layout.expand-associated-content.v1", "translation.project.v1", "translation.validate.v1", "geometry.localize-operation-groups.v1", "layout.relative-coordinates.v1", "diagnostics.unprocessed-items.v1"],
}
