"""Spatial joins, intervals, bands and whitespace groups on page nodes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafloom import fixtures as X
from leafloom.functions import box as B
from leafloom.functions import text as T
from leafloom.operators import match
from leafloom.operators import sequence as S
from leafloom.plans import query
from leafloom.session import read

INTER = "greatest(0, least(a.x+a.w, b.x+b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y+a.h, b.y+b.h) - greatest(a.y, b.y))"
HITS = "a.x < b.x+b.w and b.x < a.x+a.w and a.y < b.y+b.h and b.y < a.y+a.h"
YRATIO = "greatest(0, least(a.y+a.h, b.y+b.h) - greatest(a.y, b.y)) * 1.0 / greatest(1, least(a.h, b.h))"
BANDS = "('text_band','text_fragment')"
XYWH = ("x", "y", "w", "h")


def bands_of(spark, sf):
    return X.solid(spark, sf).where(F.col("type").isin("text_band", "text_fragment"))


def other(df, *more):
    return df.select("page_id", F.col("node_id").alias("other"), F.col("b").alias("o"), *more)


@query("jn_inline_obstacles", X.twin("solid obstacles", f"select a.node_id, b.node_id as other, cast(row_number() over (partition by a.node_id order by b.x, b.y, b.node_id) as bigint) as pos from solid a join obstacles b on a.page_id=b.page_id and {HITS} and {YRATIO} >= 0.45 where a.type in {BANDS} and b.type in ('equation','image')"))
def inline_obstacles(spark, sf):
    o = X.obstacles(spark, sf).where(F.col("type").isin("equation", "image"))
    hit = match.candidates(bands_of(spark, sf).select("page_id", "node_id", "b"), other(o), ["page_id"], B.intersects(F.col("b"), F.col("o")) & (B.y_ratio(F.col("b"), F.col("o")) >= 0.45))
    return hit.select("node_id", "other", F.row_number().over(Window.partitionBy("node_id").orderBy("o.x", "o.y", "other")).cast("bigint").alias("pos"))


@query("jn_mask_boxes", X.twin("items obstacles", f"select a.item_no, b.node_id as other, greatest(a.x,b.x) as hx, greatest(a.y,b.y) as hy, least(a.x+a.w,b.x+b.w)-greatest(a.x,b.x) as hw, least(a.y+a.h,b.y+b.h)-greatest(a.y,b.y) as hh, greatest(a.x,b.x)-a.x as lx, greatest(a.y,b.y)-a.y as ly from items a join obstacles b on a.page_id=b.page_id and {HITS} and {YRATIO} >= 0.45"))
def mask_boxes(spark, sf):
    hit = match.candidates(X.items(spark, sf).select("page_id", "item_no", "b"), other(X.obstacles(spark, sf)), ["page_id"], B.intersects(F.col("b"), F.col("o")) & (B.y_ratio(F.col("b"), F.col("o")) >= 0.45))
    c = hit.withColumn("c", B.intersection(F.col("b"), F.col("o")))
    return c.select("item_no", "other", *[F.col(f"c.{k}").alias(f"h{k}") for k in XYWH], (F.col("c.x") - F.col("b.x")).alias("lx"), (F.col("c.y") - F.col("b.y")).alias("ly"))


@query("jn_mask_fractions", X.twin("solid", f"select a.node_id, count(*) as n, max(round(i*1.0/(a_area),4)) as best_own, max(round(i*1.0/(b_area),4)) as best_other, sum(i) as overlap from (select a.node_id, a.w*a.h as a_area, b.w*b.h as b_area, {INTER} as i from solid a join solid b on a.page_id=b.page_id and {HITS} where a.type='table' and b.type<>'table') a group by a.node_id"))
def mask_fractions(spark, sf):
    s = X.solid(spark, sf)
    hit = match.candidates(s.where("type = 'table'").select("page_id", "node_id", "b"), other(s.where("type <> 'table'")), ["page_id"], B.intersects(F.col("b"), F.col("o")))
    i = hit.withColumn("i", B.overlap_area(F.col("b"), F.col("o")))
    return i.groupBy("node_id").agg(F.count("*").alias("n"), F.max(F.round(F.col("i") / B.area(F.col("b")), 4)).alias("best_own"), F.max(F.round(F.col("i") / B.area(F.col("o")), 4)).alias("best_other"), F.sum("i").alias("overlap"))


@query("jn_best_iou_match", X.twin("items solid", f"with named as (select item_no, target_node as node_id, cast(1 as double) as iou from items join (select distinct node_id as id from solid) s on s.id=target_node), scored as (select a.item_no, b.node_id, b.node_no, ({INTER})*1.0/(a.w*a.h+b.w*b.h-({INTER})) as iou from items a join solid b on a.page_id=b.page_id and {HITS} where b.type in {BANDS} and not exists (select 1 from named n where n.item_no=a.item_no)), ranked as (select *, row_number() over (partition by item_no order by iou desc, node_no) as turn from scored where iou>=0.2) select item_no, node_id, 'id' as how, round(iou,6) as iou from named union all select item_no, node_id, 'iou', round(iou,6) from ranked where turn=1"))
def best_iou_match(spark, sf):
    items, nodes = X.items(spark, sf), X.solid(spark, sf)
    ids = nodes.select(F.col("node_id").alias("target_node")).distinct()
    named = items.join(ids, "target_node").select("item_no", F.col("target_node").alias("node_id"), F.lit("id").alias("how"), F.lit(1.0).alias("iou"))
    rest = items.join(ids, "target_node", "left_anti").select("item_no", "page_id", "b")
    text = nodes.where(F.col("type").isin("text_band", "text_fragment")).select("page_id", "node_id", "node_no", F.col("b").alias("o"))
    scored = match.candidates(rest, text, ["page_id"], B.intersects(F.col("b"), F.col("o"))).withColumn("iou", B.iou(F.col("b"), F.col("o"))).where("iou >= 0.2")
    won = match.best(scored, ["item_no"], F.desc("iou"), "node_no").select("item_no", "node_id", F.lit("iou").alias("how"), F.round("iou", 6).alias("iou"))
    return named.unionByName(won)


@query("jn_owner_smallest_container", X.twin("solid", "select node_id, owner from (select a.node_id, b.node_id as owner, row_number() over (partition by a.node_id order by b.w*b.h, b.node_id) as turn from solid a join solid b on a.page_id=b.page_id and a.node_id<>b.node_id and a.x>=b.x-12 and a.y>=b.y-12 and a.x+a.w<=b.x+b.w+12 and a.y+a.h<=b.y+b.h+12 where b.type in ('table','image','diagram_component')) where turn=1"))
def owner_smallest_container(spark, sf):
    s = X.solid(spark, sf)
    o = other(s.where(F.col("type").isin("table", "image", "diagram_component")))
    hit = match.candidates(s.select("page_id", "node_id", "b"), o, ["page_id"], (F.col("node_id") != F.col("other")) & B.contains(F.col("o"), F.col("b"), 12))
    return match.best(hit, ["node_id"], B.area(F.col("o")), "other").select("node_id", F.col("other").alias("owner"))


@query("jn_centre_in_region", X.twin("solid", "select a.node_id, min(b.node_id) as region from solid a left join solid b on a.page_id=b.page_id and b.type='table' and a.node_id<>b.node_id and a.x+a.w/2.0 between b.x-3 and b.x+b.w+3 and a.y+a.h/2.0 between b.y-3 and b.y+b.h+3 group by a.node_id"))
def centre_in_region(spark, sf):
    s = X.solid(spark, sf)
    cx, cy = F.col("b.x") + F.col("b.w") / 2, F.col("b.y") + F.col("b.h") / 2
    inside = (F.col("node_id") != F.col("other")) & cx.between(F.col("o.x") - 3, B.right(F.col("o")) + 3) & cy.between(F.col("o.y") - 3, B.bottom(F.col("o")) + 3)
    return match.candidates(s.select("page_id", "node_id", "b"), other(s.where("type = 'table'")), ["page_id"], inside, "left").groupBy("node_id").agg(F.min("other").alias("region"))


RULES = "rules as (select page_id, y as rule_y, node_id as rule_id from solid where type='rule' and w>=20*h or (type='rule' and w>=300))"


@query("jn_rule_sections", X.twin("solid", f"with {RULES}, m as (select page_id, rule_y, max(rule_id) as rule_id from rules group by all), s as (select n.node_id, max(m.rule_y) as top from solid n left join m on m.page_id=n.page_id and m.rule_y <= n.y+n.h/2.0 where n.type<>'rule' group by n.node_id) select s.node_id, coalesce(m.rule_id,'top') as section from s join solid n on n.node_id=s.node_id left join m on m.page_id=n.page_id and m.rule_y=s.top"))
def rule_sections(spark, sf):
    s = X.solid(spark, sf)
    rules = s.where("type = 'rule' and (w >= 20 * h or w >= 300)").groupBy("page_id", F.col("y").cast("double").alias("at")).agg(F.max("node_id").alias("section"))
    rows = s.where("type <> 'rule'").select("page_id", (F.col("y") + F.col("h") / 2).alias("at"), "node_id")
    return match.as_of(rows, rules, ["page_id"], "at", "section").select("node_id", F.coalesce("section", F.lit("top")).alias("section"))


@query("flt_horizontal_rules", X.twin("solid page_sizes", "select n.node_id, cast(row_number() over (partition by n.page_id order by n.y, n.node_id) as bigint) as pos from solid n join page_sizes p on p.page_id=n.page_id where n.type='rule' and n.w>=0.3*p.width and n.w>=4*n.h"))
def horizontal_rules(spark, sf):
    j = X.solid(spark, sf).join(X.page_sizes(spark, sf), "page_id").where("type = 'rule' and w >= 0.3 * width and w >= 4 * h")
    return j.select("node_id", F.row_number().over(Window.partitionBy("page_id").orderBy("y", "node_id")).cast("bigint").alias("pos"))


@query("flt_terminal_kind", X.twin("nodes", "select case when type in ('text_band','text_fragment','heading','caption','page_number','header','footer') then 'text' when type in ('rule','diagram_component','table') then 'graphic' else 'opaque' end as kind, count(*) as n, sum(w*h) as area from nodes group by 1"))
def terminal_kind(spark, sf):
    kind = F.when(F.col("type").isin("text_band", "text_fragment", "heading", "caption", "page_number", "header", "footer"), "text").when(F.col("type").isin("rule", "diagram_component", "table"), "graphic").otherwise("opaque")
    return X.nodes(spark, sf).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("h")).alias("area"))


@query("flt_render_policy", X.twin("nodes", r"select node_id, case when t<>'' and not regexp_matches(t, '\\(?:frac|sqrt|sum|prod|int|begin|overline|underline|overset|underset|vec|hat|bar|left|right)|[_^].*[_^]') and length(t)<=12 and not contains(t, '\\') then 'text' when node_no%2=0 then 'inline_math' else 'display_math' end as policy from (select node_id, node_no, trim(coalesce(latex,'')) as t from nodes where type='equation')"))
def render_policy(spark, sf):
    return X.nodes(spark, sf).where("type = 'equation'").select("node_id", T.render_policy(F.col("latex"), F.col("node_no") % 2 == 0).alias("policy"))


@query("flt_suppress_bands", X.twin("solid page_sizes", "select node_id, band from (select n.node_id, b.band, b.pos, row_number() over (partition by n.node_id order by b.pos) as turn from solid n join page_sizes p on p.page_id=n.page_id cross join (values (1,'header',0.0,0.06),(2,'footer',0.94,1.0)) b(pos, band, lo, hi) where n.type in ('text_band','text_fragment','page_number') and greatest(0, least(n.y+n.h, b.hi*p.height)-greatest(n.y, b.lo*p.height))/n.h >= 0.35) where turn=1"))
def suppress_bands(spark, sf):
    n = X.solid(spark, sf).where(F.col("type").isin("text_band", "text_fragment", "page_number")).join(X.page_sizes(spark, sf), "page_id")
    part = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col("y") + F.col("h"), hi * F.col("height")) - F.greatest(F.col("y"), lo * F.col("height"))) / F.col("h")
    return n.select("node_id", F.when(part(0.0, 0.06) >= 0.35, "header").when(part(0.94, 1.0) >= 0.35, "footer").alias("band")).where("band is not null")


ISL = "select page_id, y, h, node_no, max(y+h) over (partition by page_id order by y, node_no rows between unbounded preceding and 1 preceding) as reach from solid where type in ('text_band','text_fragment')"


@query("isl_y_bands", X.twin("solid", f"with s as ({ISL}), i as (select *, sum(case when reach is null or y>reach then 1 else 0 end) over (partition by page_id order by y, node_no rows between unbounded preceding and current row) as band from s) select page_id, cast(band as bigint) as band, min(y) as y, max(y+h) as y2, count(*) as n from i group by page_id, band"))
def y_bands(spark, sf):
    s = bands_of(spark, sf).withColumn("y2", F.col("y") + F.col("h"))
    reach = F.max("y2").over(Window.partitionBy("page_id").orderBy("y", "node_no").rowsBetween(Window.unboundedPreceding, -1))
    ided = S.island_ids(s.withColumn("reach", reach), ["page_id"], ["y", "node_no"], F.coalesce(F.col("y") > F.col("reach"), F.lit(True)), "band")
    return ided.groupBy("page_id", F.col("band").cast("bigint").alias("band")).agg(F.min("y").alias("y"), F.max("y2").alias("y2"), F.count("*").alias("n"))


@query("isl_interval_union", X.twin("solid", "with s as (select page_id, x as lo, x+w as hi, max(x+w) over (partition by page_id order by x, x+w rows between unbounded preceding and 1 preceding) as reach from solid), i as (select *, sum(case when reach is null or lo>reach then 1 else 0 end) over (partition by page_id order by lo, hi rows between unbounded preceding and current row) as part from s) select page_id, min(lo) as lo, max(hi) as hi from i group by page_id, part"))
def interval_union(spark, sf):
    return S.union_of_intervals(X.solid(spark, sf).select("page_id", F.col("x").alias("lo"), (F.col("x") + F.col("w")).alias("hi")), ["page_id"], "lo", "hi")


def fragments(spark, sf, margin: int, least: int):
    band = bands_of(spark, sf)
    o = X.obstacles(spark, sf).where(F.col("type").isin("equation", "image"))
    hit = match.candidates(band.select("page_id", "node_id", "b"), other(o), ["page_id"], B.intersects(F.col("b"), F.col("o")) & (B.y_ratio(F.col("b"), F.col("o")) >= 0.45))
    blocks = hit.select("node_id", F.col("o.x").alias("lo"), B.right(F.col("o")).alias("hi"))
    frames = band.select("node_id", F.col("x").alias("lo"), (F.col("x") + F.col("w")).alias("hi"))
    return S.gaps(frames, blocks, ["node_id"], "lo", "hi", least, margin)


def fragments_sql(margin: int, least: int) -> str:
    return X.twin("solid obstacles", f"with blocks as (select a.node_id, greatest(b.x-{margin}, a.x) as lo, least(b.x+b.w+{margin}, a.x+a.w) as hi from solid a join obstacles b on a.page_id=b.page_id and {HITS} and {YRATIO}>=0.45 where a.type in {BANDS} and b.type in ('equation','image')), edges as (select node_id, lo, max(hi) over (partition by node_id order by lo, hi rows between unbounded preceding and 1 preceding) as reach from blocks where hi>lo), final as (select node_id, max(hi) as hi from blocks where hi>lo group by node_id) select node_id, coalesce(reach, x) as lo, e.lo as hi from edges e join solid s using (node_id) where e.lo - coalesce(reach, x) >= {least} union all select s.node_id, coalesce(f.hi, s.x), s.x+s.w from solid s left join final f on f.node_id=s.node_id where s.type in {BANDS} and s.x+s.w-coalesce(f.hi, s.x) >= {least}")


query("isl_fragments", fragments_sql(0, 1))(lambda spark, sf: fragments(spark, sf, 0, 1))
query("isl_text_segments", fragments_sql(3, 16))(lambda spark, sf: fragments(spark, sf, 3, 16))


@query("isl_run_bands", X.twin("ink", "with r as (select page_id, y, y - row_number() over (partition by page_id order by y) as g from ink where v>0), b as (select page_id, min(y) as start, max(y)+1 as stop from r group by page_id, g having count(*)>=2), m as (select *, sum(case when start - lag_stop <= 1 then 0 else 1 end) over (partition by page_id order by start rows between unbounded preceding and current row) as band from (select *, lag(stop) over (partition by page_id order by start) as lag_stop from b)) select page_id, cast(band as bigint) as band, min(start) as start, max(stop) as stop from m group by page_id, band"))
def run_bands(spark, sf):
    return S.bands(X.ink(spark, sf), ["page_id"], "y", F.col("v") > 0, 2, 1).withColumn("band", F.col("band").cast("bigint"))


@query("isl_merge_runs_to_count", X.twin("ink", "with r as (select page_id, y, y - row_number() over (partition by page_id order by y) as g from ink where v>0), b as (select page_id, min(y) as start, max(y)+1 as stop from r group by page_id, g), l as (select *, start - lag(stop) over (partition by page_id order by start) as gap, count(*) over (partition by page_id) as n from b), k as (select *, row_number() over (partition by page_id order by gap nulls last, start) as turn from l), i as (select *, sum(case when gap is null or turn > n-4 then 1 else 0 end) over (partition by page_id order by start rows between unbounded preceding and current row) as part from k) select page_id, min(start) as start, max(stop) as stop from i group by page_id, part"))
def merge_runs_to_count(spark, sf):
    runs = S.bands(X.ink(spark, sf), ["page_id"], "y", F.col("v") > 0, 1, 0).drop("band").withColumn("wanted", F.lit(4))
    return S.merged_to_count(runs, ["page_id"], "start", "stop", "wanted")


WS = f"""with s as ({ISL.replace("select page_id, y, h,", "select page_id, x, w, y, h,")}), i as (select *, sum(case when reach is null or y>reach then 1 else 0 end) over (partition by page_id order by y, node_no rows between unbounded preceding and current row) as band from s),
b as (select page_id, band, min(y) as y, max(y+h) as y2, min(x) as x, max(x+w) as x2, list_sort(list(h))[cast(floor(count(*)/2) as int)+1] as mh from i group by page_id, band),
p as (select *, lag(y2) over w as prev, max(x2) over (w rows between unbounded preceding and 1 preceding) - min(x) over (w rows between unbounded preceding and 1 preceding) as pw, max(x2) over (w rows between current row and unbounded following) - min(x) over (w rows between current row and unbounded following) as sw, max(x2) over (partition by page_id) - min(x) over (partition by page_id) as ow from b window w as (partition by page_id order by y)),
m as (select page_id, list_sort(list(y2-y))[cast(floor(count(*)/2) as int)+1] as height from b group by page_id),
g as (select p.*, sum(case when prev is null then 1 when p.y-prev >= greatest(24, 0.5*m.height) and least(pw, sw) >= 0.5*ow then 1 else 0 end) over (partition by p.page_id order by p.y rows between unbounded preceding and current row) as grp from p join m on m.page_id=p.page_id)
select page_id, cast(grp as bigint) as grp, min(y) as y, max(y2) as y2, count(*) as n_bands from g group by page_id, grp"""


def whitespace_groups(nodes, min_gap: float, factor: float, share: float):
    """Bands of touching nodes, split where the gap is tall and both sides are wide."""
    s = nodes.withColumn("y2", F.col("y") + F.col("h")).withColumn("x2", F.col("x") + F.col("w"))
    w = Window.partitionBy("page_id").orderBy("y", "node_no")
    reach = F.max("y2").over(w.rowsBetween(Window.unboundedPreceding, -1))
    ided = S.island_ids(s.withColumn("reach", reach), ["page_id"], ["y", "node_no"], F.coalesce(F.col("y") > F.col("reach"), F.lit(True)), "band")
    b = ided.groupBy("page_id", "band").agg(F.min("y").alias("y"), F.max("y2").alias("y2"), F.min("x").alias("x"), F.max("x2").alias("x2"))
    o = Window.partitionBy("page_id").orderBy("y")
    before, after, whole = o.rowsBetween(Window.unboundedPreceding, -1), o.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy("page_id")
    width = lambda frame: F.max("x2").over(frame) - F.min("x").over(frame)
    heights = F.sort_array(F.collect_list(F.col("y2") - F.col("y")).over(whole))
    p = b.withColumn("gap", F.col("y") - F.lag("y2").over(o)).withColumn("narrow", F.least(width(before), width(after))).withColumn("occupied", width(whole)).withColumn("height", F.element_at(heights, (F.size(heights) / 2).cast("int") + 1))
    split = F.col("gap").isNull() | ((F.col("gap") >= F.greatest(F.lit(min_gap), factor * F.col("height"))) & (F.col("narrow") >= share * F.col("occupied")))
    return S.island_ids(p, ["page_id"], ["y"], split, "grp").groupBy("page_id", F.col("grp").cast("bigint").alias("grp")).agg(F.min("y").alias("y"), F.max("y2").alias("y2"), F.count("*").alias("n_bands"))


@query("isl_whitespace_groups", X.twin("solid", WS))
def whitespace(spark, sf):
    return whitespace_groups(bands_of(spark, sf), 24, 0.5, 0.5)


@query("isl_indent_runs", X.twin("solid", "with s as (select page_id, node_no, x - min(x) over (partition by page_id) as indent, coalesce(x - lag(x) over (partition by page_id order by y, node_no), 0) as delta, x, y from solid where type in ('text_band','text_fragment')), r as (select *, sum(case when abs(delta)>2 then 1 else 0 end) over (partition by page_id order by y, node_no rows between unbounded preceding and current row) as run from s) select node_no, indent, delta, cast(run as bigint) as run, first_value(x) over (partition by page_id, run order by y, node_no) as run_x from r"))
def indent_runs(spark, sf):
    w = Window.partitionBy("page_id").orderBy("y", "node_no")
    s = bands_of(spark, sf).withColumn("indent", F.col("x") - F.min("x").over(Window.partitionBy("page_id"))).withColumn("delta", F.coalesce(F.col("x") - F.lag("x").over(w), F.lit(0)))
    r = S.island_ids(s, ["page_id"], ["y", "node_no"], F.abs("delta") > 2, "run")
    return r.select("node_no", "indent", "delta", F.col("run").cast("bigint").alias("run"), F.first("x").over(Window.partitionBy("page_id", "run").orderBy("y", "node_no")).alias("run_x"))


@query("isl_growth_shift", X.twin("solid", "select node_no, y + coalesce(sum(greatest(0, cast(length(coalesce(text,'')) as bigint) - h)) over (partition by page_id order by y, node_no rows between unbounded preceding and 1 preceding), 0) as y, greatest(h, cast(length(coalesce(text,'')) as bigint)) as h from solid"))
def growth_shift(spark, sf):
    need = F.length(F.coalesce("text", F.lit(""))).cast("bigint")
    before = Window.partitionBy("page_id").orderBy("y", "node_no").rowsBetween(Window.unboundedPreceding, -1)
    return X.solid(spark, sf).select("node_no", (F.col("y") + F.coalesce(F.sum(F.greatest(F.lit(0), need - F.col("h"))).over(before), F.lit(0))).alias("y"), F.greatest("h", need).alias("h"))


@query("agg_bbox_union", X.twin("solid", "select page_id, type, min(x) as x, min(y) as y, max(x+w)-min(x) as w, max(y+h)-min(y) as h, count(*) as n from solid group by page_id, type"))
def bbox_union(spark, sf):
    g = X.solid(spark, sf).groupBy("page_id", "type").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"), F.count("*").alias("n"))
    return g.select("page_id", "type", "x", "y", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"), "n")


@query("agg_line_summary", X.twin("solid", "with s as (select page_id, x, row_number() over (partition by page_id order by y, node_no) as k from solid where type in ('text_band','text_fragment')) select page_id, count(*) as n, max(case when k=1 then x end) as first_x, round_even(quantile_cont(case when k>1 then x end, 0.5), 0) as median_x, coalesce(max(case when k>1 then x end)-min(case when k>1 then x end)<=2, false) as same_indent, max(x)-min(x) as spread from s group by page_id"))
def line_summary(spark, sf):
    s = bands_of(spark, sf).withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("y", "node_no")))
    rest = F.when(F.col("k") > 1, F.col("x"))
    return s.groupBy("page_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("k") == 1, F.col("x"))).alias("first_x"), F.bround(F.percentile(rest, 0.5)).alias("median_x"), F.coalesce(F.max(rest) - F.min(rest) <= 2, F.lit(False)).alias("same_indent"), (F.max("x") - F.min("x")).alias("spread"))


@query("agg_compose_page", X.twin("solid", "select page_id, count(*) as n, string_agg(node_id, ',' order by y, x, type, node_id) as order_list, count(*) filter (type in ('text_band','text_fragment')) as n_text, count(*) filter (type='equation') as n_equation from solid group by page_id"))
def compose_page(spark, sf):
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "type", "node_id"))), lambda s: s["node_id"]), ",")
    return X.solid(spark, sf).groupBy("page_id").agg(F.count("*").alias("n"), ordered.alias("order_list"), F.count_if(F.col("type").isin("text_band", "text_fragment")).alias("n_text"), F.count_if(F.col("type") == "equation").alias("n_equation"))


@query("top_footer_label", X.twin("nodes page_sizes", "select page_id, label from (select n.page_id, trim(n.text) as label, row_number() over (partition by n.page_id order by n.y desc, n.x desc, trim(n.text) desc, n.node_id desc) as turn from nodes n join page_sizes p on p.page_id=n.page_id where regexp_full_match(trim(n.text), '[0-9]{1,5}') and n.y>=0.82*p.height) where turn=1"))
def footer_label(spark, sf):
    n = X.nodes(spark, sf).join(X.page_sizes(spark, sf), "page_id").withColumn("label", F.trim("text")).where(F.col("label").rlike(r"^[0-9]{1,5}$") & (F.col("y") >= 0.82 * F.col("height")))
    return n.groupBy("page_id").agg(F.max_by("label", F.struct("y", "x", "label", "node_id")).alias("label"))


@query("fn_box_algebra", X.twin("solid page_sizes", "select n.node_id, least(greatest(x-7,0),width-1) as cx, greatest(1, least(x-7+w+14, width)-least(greatest(x-7,0),width-1)) as cw, cast(round_even(x*1.5,0) as bigint) as sx, greatest(1, cast(round_even(w*0.01,0) as bigint)) as sw, format('left:{}px;top:{}px;width:{}px;height:{}px', x, y, w, h) as style from solid n join page_sizes p on p.page_id=n.page_id"))
def box_algebra(spark, sf):
    j = X.solid(spark, sf).join(X.page_sizes(spark, sf), "page_id")
    inflated = B.inflate(F.col("b"), 7, F.col("width"), F.col("height"))
    s = B.scaled(F.col("b"), F.lit(1.5), F.lit(1.5))
    thin = B.scaled(F.col("b"), F.lit(0.01), F.lit(1.0))
    return j.select("node_id", inflated["x"].alias("cx"), inflated["w"].alias("cw"), s["x"].alias("sx"), thin["w"].alias("sw"), B.css(F.col("b")).alias("style"))


@query("src_pages_flatten", "select p.page_id, p.book_id, count(distinct n.node_no) as n_nodes, max(p.rev_no) as rev_no from renderable_pages p left join page_nodes n on n.page_id=p.page_id where p.page_id is not null group by p.page_id, p.book_id")
def pages_flatten(spark, sf):
    p = read(spark, sf, "renderable_pages").where("page_id is not null").groupBy("page_id", "book_id").agg(F.max("rev_no").alias("rev_no"))
    n = read(spark, sf, "page_nodes").groupBy("page_id").agg(F.countDistinct("node_no").alias("n_nodes"))
    return p.join(n, "page_id", "left").select("page_id", "book_id", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), "rev_no")


@query("flt_project_pages", "select rec_id, page_id, cast(row_number() over (partition by book_id order by source_page_index, rec_id) as bigint) as out_index, media_box[3]-media_box[1] as mw, media_box[4]-media_box[2] as mh from (select distinct rec_id, page_id, book_id, source_page_index, media_box from renderable_pages where len(media_box)=4) where media_box[3]>media_box[1] and media_box[4]>media_box[2]")
def project_pages(spark, sf):
    p = read(spark, sf, "renderable_pages").where("size(media_box) = 4").select("rec_id", "page_id", "book_id", "source_page_index", "media_box").distinct()
    m = F.col("media_box")
    good = p.where((m[2] > m[0]) & (m[3] > m[1]))
    return good.select("rec_id", "page_id", F.row_number().over(Window.partitionBy("book_id").orderBy("source_page_index", "rec_id")).cast("bigint").alias("out_index"), (m[2] - m[0]).alias("mw"), (m[3] - m[1]).alias("mh"))
