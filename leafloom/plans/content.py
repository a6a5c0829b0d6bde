"""Queries on content-stream operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafloom import fixtures as X
from leafloom.operators import content as C
from leafloom.operators import sequence as S
from leafloom.operators import match
from leafloom.plans import query
from leafloom.session import materialize

OPENS, CLOSES = "('q','BT','BDC','BMC')", "('Q','ET','EMC')"
DEPTH = f"d as (select *, sum(case when operator in {OPENS} then 1 when operator in {CLOSES} then -1 else 0 end) over (partition by page_id order by ordinal rows between unbounded preceding and current row) + case when operator in {CLOSES} then 1 else 0 end as depth from ops)"
UP = "over (partition by page_id order by ordinal rows between unbounded preceding and current row)"
PRE = "over (partition by page_id order by ordinal rows between unbounded preceding and 1 preceding)"
POST = "over (partition by page_id order by ordinal rows between current row and unbounded following)"


def lastv(ops: str, col: str = "ordinal", frame: str = UP) -> str:
    return f"last_value(case when operator in ({ops}) then {col} end ignore nulls) {frame}"


def nextv(ops: str, col: str = "ordinal") -> str:
    return f"first_value(case when operator in ({ops}) then {col} end ignore nulls) {POST}"


@query("isl_scope_depth", X.twin("ops", f"with {DEPTH} select page_id, ordinal, cast(depth as bigint) as depth from d"))
def scope_depth(spark, sf):
    return C.depth(X.ops(spark, sf)).select("page_id", "ordinal", F.col("depth").cast("bigint").alias("depth"))


@query("isl_scope_pairs", X.twin("ops", f"with {DEPTH}, t as materialized (select page_id, ordinal, depth, operator in {OPENS} as o, row_number() over (partition by page_id, depth, operator in {OPENS} order by ordinal) as k from d where operator in {OPENS} or operator in {CLOSES}) select page_id, a.ordinal as opened, b.ordinal as closed, cast(depth as bigint) as depth from (select * from t where o) a join (select * from t where not o) b using (page_id, depth, k)"))
def scope_pairs(spark, sf):
    p = S.scope_pairs(X.ops(spark, sf), ["page_id"], "ordinal", C.opens(), C.closes())
    return p.select("page_id", "opened", "closed", F.col("depth").cast("bigint").alias("depth"))


@query("isl_scope_tree_stack", X.twin("ops", f"with {DEPTH}, t as materialized (select page_id, ordinal, depth, operator in {OPENS} as o, row_number() over (partition by page_id, depth, operator in {OPENS} order by ordinal) as k from d where operator in {OPENS} or operator in {CLOSES}), p as (select a.page_id, a.ordinal as opened, b.ordinal as closed from t a join t b on a.page_id=b.page_id and a.depth=b.depth and a.k=b.k and a.o and not b.o) select o.page_id, o.ordinal, max(p.opened) as parent from ops o left join p on p.page_id=o.page_id and o.ordinal>p.opened and o.ordinal<=p.closed group by o.page_id, o.ordinal"))
def scope_tree_stack(spark, sf):
    """The stack machine agrees with the pairs on pages that nest."""
    return C.structured(X.ops(spark, sf)).select("page_id", "ordinal", "parent")


@query("isl_graphics_pairs", X.twin("ops", "with a as (select page_id, ordinal, row_number() over (partition by page_id order by ordinal) k from ops where operator='q'), b as (select page_id, ordinal, row_number() over (partition by page_id order by ordinal) k from ops where operator='Q') select a.page_id, a.ordinal as opened, b.ordinal as closed from a join b using (page_id, k)"))
def graphics_pairs(spark, sf):
    return C.pairs(X.ops(spark, sf), "q", "Q")


@query("isl_marked_ranges", X.twin("ops", f"select page_id, ordinal, start from (select page_id, ordinal, {lastv(chr(39) + 'BDC' + chr(39))} as start, {lastv(chr(39) + 'EMC' + chr(39), 'ordinal', PRE)} as stop from ops) where start is not null and (stop is null or stop < start)"))
def marked_ranges(spark, sf):
    """Every ordinal of a marked range with the range's opener."""
    p = C.pairs(X.ops(spark, sf), "BDC", "EMC")
    return p.select("page_id", F.explode(F.sequence("opened", "closed")).alias("ordinal"), F.col("opened").alias("start"))


@query("isl_state_carry", X.twin("ops", f"select page_id, ordinal, {lastv(chr(39) + 'Tf' + chr(39), 'w', PRE)} as font_size from ops"))
def state_carry(spark, sf):
    return C.font_state(X.ops(spark, sf)).select("page_id", "ordinal", "font_size")


@query("isl_text_candidates", X.twin("ops", f"""with s as (select *, {lastv("'Tf'", "w")} as fs, {lastv("'BT'")} as bt, {lastv("'ET'")} as et, {lastv("'Tm'")} as tm, {lastv("'Tm'", "x")} as tx, {lastv("'Tm'", "y")} as ty from ops) select page_id, ordinal, tx as x, 800.0-ty-fs as y, greatest(0.5*fs, 5*0.5*fs) as w, fs as h from s where operator in ('Tj','TJ') and tm>bt and coalesce(et,-1)<bt"""))
def text_candidates(spark, sf):
    return C.text_candidates(X.ops(spark, sf))


TEXT_SPANS = f"""scopes as materialized (select *, {lastv("'BT'")} as bt, {nextv("'ET'")} as et, {lastv("'q','Q','BT','ET','BDC','EMC'", "ordinal", PRE)} as bo, {lastv("'q','Q','BT','ET','BDC','EMC'", "operator", PRE)} as bop, lead(operator) over (partition by page_id order by ordinal) as follow from ops), text_spans as (select page_id, t.ordinal, case when b.bop='q' then b.bo else b.ordinal end as start, e.ordinal + case when e.follow='Q' then 1 else 0 end as stop from (select page_id, ordinal, bt, et from scopes where operator in ('Tj','TJ')) t join (select page_id, ordinal as bt, ordinal, bo, bop from scopes where operator='BT') b using (page_id, bt) join (select page_id, ordinal as et, ordinal, follow from scopes where operator='ET') e using (page_id, et))"""


@query("isl_text_spans", X.twin("ops", f"with {TEXT_SPANS} select * from text_spans"))
def text_spans(spark, sf):
    return C.text_spans(X.ops(spark, sf))


BLOCKS = f"""s as (select *, {lastv("'BDC'")} as start, {nextv("'EMC'")} as stop from ops), blocks as (select page_id, start, max(stop) as stop, min(x) filter (operator in ('m','l','c')) as x, min(y) filter (operator in ('m','l','c')) as y, max(x) filter (operator in ('m','l','c')) as x2, max(y) filter (operator in ('m','l','c')) as y2 from s where start is not null and ordinal <= stop and operator in ('BDC','m','l','S','EMC') group by page_id, start)"""
CLUSTERS = f"{BLOCKS}, n as (select *, start - lag(stop) over (partition by page_id order by start) as gap from blocks), i as (select *, sum(case when gap is null or gap>8 then 1 else 0 end) over (partition by page_id order by start rows between unbounded preceding and current row) as cl from n), clusters as (select page_id, min(start) as start, max(stop) as stop, min(x) as x, min(y) as y, max(x2) as x2, max(y2) as y2, count(*) as n from i group by page_id, cl having count(*)>=2)"


@query("isl_marked_blocks", X.twin("ops", f"with {BLOCKS} select * from blocks"))
def marked_blocks(spark, sf):
    return C.marked_blocks(X.ops(spark, sf))


@query("isl_cluster_gap8", X.twin("ops", f"with {CLUSTERS} select * from clusters"))
def cluster_gap8(spark, sf):
    return C.clusters(C.marked_blocks(X.ops(spark, sf)))


SPANS = """spans as (select page_id, k, case when max(case when operator='BT' then 1 else 0 end)=1 then 'text_span' else 'path_span' end as kind, min(ordinal) as first, max(ordinal) as last, count(*) as n, max(case when operator='re' then greatest(w,h) end) as long, max(case when operator='re' then least(w,h) end) as thin from ops where operator in ('BT','Tf','Tm','Tj','ET','m','l','S','re','f*') group by page_id, k)"""


@query("isl_visual_spans", X.twin("ops", f"with {SPANS} select page_id, kind, first, last, n from spans"))
def visual_spans(spark, sf):
    return C.visual_spans(X.ops(spark, sf)).select("page_id", "kind", "first", "last", "n")


@query("tr_unprocessed", X.twin("ops", f"with {CLUSTERS}, {SPANS}, c as (select s.page_id, case when kind='text_span' then 'text_content_candidate' when long is null then case when n - 1 <= 2 then 'radical_or_geometry_stroke_candidate' else 'geometry_stroke_candidate' end when long>=6 and thin<=2.5 then 'thin_rule_or_fraction_bar_candidate' else 'filled_geometry_candidate' end as class, n from spans s where not exists (select 1 from clusters o where o.page_id=s.page_id and s.first >= o.start and s.last <= o.stop)) select coalesce(cast(page_id as varchar),'all') as page_id, coalesce(class,'all') as class, count(*) as n_items, sum(n) as n_ops from c group by rollup(page_id, class)"))
def unprocessed(spark, sf):
    """Spans that no cluster owns whole, by class, with totals. Clusters are apart, so the last one at or before an operation tells whether it is in one."""
    ops = materialize(X.ops(spark, sf), "ops")
    clusters = C.clusters(C.marked_blocks(ops)).select("page_id", F.col("start").alias("ordinal"), "stop")
    marked = match.as_of(ops, clusters, ["page_id"], "ordinal", "stop")
    left = C.classify(C.visual_spans(marked, F.coalesce(F.col("ordinal") <= F.col("stop"), F.lit(False))).where("not owned"))
    r = left.rollup("page_id", "class").agg(F.count("*").alias("n_items"), F.sum("n").alias("n_ops"))
    return r.select(F.coalesce(F.col("page_id").cast("string"), F.lit("all")).alias("page_id"), F.coalesce("class", F.lit("all")).alias("class"), "n_items", "n_ops")


@query("flt_content_layer_split", X.twin("ops", "select operator, count(*) as n_removed from ops where operator in ('BT','ET','Tf','Tm','Tj') group by operator"))
def content_layer_split(spark, sf):
    return X.ops(spark, sf).where(C.is_in(C.TEXT)).groupBy("operator").agg(F.count("*").alias("n_removed"))


@query("src_painted_rectangles", X.twin("ops", "select page_id, ordinal, x, y, w, h from (select *, lead(operator) over (partition by page_id order by ordinal) as follow from ops) where operator='re' and follow in ('f','f*','B','B*','b','b*','S') and w>0 and h>0 and not (w>0.95*600 and h>0.95*800)"))
def painted_rectangles(spark, sf):
    follow = F.lead("operator").over(Window.partitionBy("page_id").orderBy("ordinal"))
    o = X.ops(spark, sf).withColumn("follow", follow).where("operator = 're'")
    return o.where(F.col("follow").isin("f", "f*", "B", "B*", "b", "b*", "S") & (F.col("w") > 0) & (F.col("h") > 0) & ~((F.col("w") > 0.95 * 600) & (F.col("h") > 0.95 * 800))).select("page_id", "ordinal", "x", "y", "w", "h")


@query("src_path_bbox", X.twin("ops", "select page_id, min(x) as x, min(y) as y, max(x)-min(x) as w, max(y)-min(y) as h from ops where operator in ('m','l','c') group by page_id"))
def path_bbox(spark, sf):
    p = X.ops(spark, sf).where(C.is_in(["m", "l", "c"])).groupBy("page_id")
    return p.agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))


BARS = "bars as (select page_id, ordinal, x, y, w, h from ops where operator='re')"


@query("jn_frame_pairs", X.twin("ops", f"with {BARS} select a.page_id, a.ordinal as upper, b.ordinal as lower from bars a join bars b on a.page_id=b.page_id and a.ordinal<>b.ordinal and abs(a.w-b.w)<=2 and a.y>=b.y+10 and abs(a.x-b.x)<=60 where exists (select 1 from bars v where v.page_id=a.page_id and v.ordinal not in (a.ordinal, b.ordinal) and v.y between b.y and a.y)"))
def frame_pairs(spark, sf):
    """Pairs of like bars one above the other with a third one between them."""
    bars = X.ops(spark, sf).where("operator = 're'").select("page_id", "ordinal", "x", "y", "w", "h")
    a, b, v = bars.alias("a"), bars.alias("b"), bars.alias("v")
    pair = a.join(b, (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.ordinal") != F.col("b.ordinal")) & (F.abs(F.col("a.w") - F.col("b.w")) <= 2) & (F.col("a.y") >= F.col("b.y") + 10) & (F.abs(F.col("a.x") - F.col("b.x")) <= 60))
    p = pair.select(F.col("a.page_id").alias("page_id"), F.col("a.ordinal").alias("upper"), F.col("b.ordinal").alias("lower"), F.col("a.y").alias("hi"), F.col("b.y").alias("lo"))
    return p.join(v, (F.col("v.page_id") == p.page_id) & (F.col("v.ordinal") != F.col("upper")) & (F.col("v.ordinal") != F.col("lower")) & F.col("v.y").between(F.col("lo"), F.col("hi")), "left_semi").select("page_id", "upper", "lower")


OWN = "owned as (select page_id, ordinal, 'g' || k as group_id from ops where operator not in ('n','Q'))"


def owned(ops):
    return ops.where("operator not in ('n', 'Q')").select("page_id", "ordinal", F.concat(F.lit("g"), F.col("k").cast("string")).alias("group_id"))


@query("set_unowned_ops", X.twin("ops", f"with {OWN} select page_id, ordinal from ops except select page_id, ordinal from owned"))
def unowned(spark, sf):
    ops = X.ops(spark, sf)
    return ops.select("page_id", "ordinal").join(owned(ops), ["page_id", "ordinal"], "left_anti")


@query("set_parity", X.twin("ops", "select page_id, count(*) as n_ops, count(*) - count(distinct ordinal) as n_repeated, max(ordinal) + 1 - count(distinct ordinal) as n_missing, min(ordinal) as first from ops group by page_id"))
def parity(spark, sf):
    d = F.countDistinct("ordinal")
    return X.ops(spark, sf).groupBy("page_id").agg(F.count("*").alias("n_ops"), (F.count("*") - d).alias("n_repeated"), (F.max("ordinal") + 1 - d).alias("n_missing"), F.min("ordinal").alias("first"))


@query("val_operation_parity", X.twin("ops", f"with {DEPTH}, t as (select page_id, ordinal, row_number() over (partition by page_id order by ordinal) - 1 as place from d) select page_id, count(*) as n, min(case when ordinal<>place then place end) as first_mismatch from t group by page_id"))
def operation_parity(spark, sf):
    """The flattened tree against the raw order: rows and the first place at which they differ."""
    ops = X.ops(spark, sf)
    w = Window.partitionBy("page_id").orderBy("ordinal")
    tree = C.depth(ops).select("page_id", "ordinal", (F.row_number().over(w) - 1).alias("place"))
    return tree.groupBy("page_id").agg(F.count("*").alias("n"), F.min(F.when(F.col("ordinal") != F.col("place"), F.col("place"))).cast("bigint").alias("first_mismatch"))


@query("set_sibling_overlap", X.twin("ops", "with c as (select page_id, ordinal, k as g from ops union all select page_id, ordinal, k+1 from ops where operator in ('ET','EMC','n')) select a.page_id, a.g as left_group, b.g as right_group, count(*) as n from c a join c b on a.page_id=b.page_id and a.ordinal=b.ordinal and a.g<b.g group by a.page_id, a.g, b.g"))
def sibling_overlap(spark, sf):
    """Operations that two siblings claim."""
    ops = X.ops(spark, sf)
    c = ops.select("page_id", "ordinal", F.col("k").alias("g")).unionByName(ops.where(C.is_in(["ET", "EMC", "n"])).select("page_id", "ordinal", (F.col("k") + 1).alias("g")))
    a, b = c.withColumnRenamed("g", "left_group"), c.withColumnRenamed("g", "right_group")
    return a.join(b, ["page_id", "ordinal"]).where("left_group < right_group").groupBy("page_id", "left_group", "right_group").agg(F.count("*").alias("n"))


@query("val_ownership", X.twin("ops", "with claims as (select page_id, ordinal, 'g'||k as g from ops where operator<>'n' union all select page_id, ordinal, 'h'||k from ops where operator='S' union all select page_id, ordinal+100000, 'x'||k from ops where operator='Do' or w>=50 and operator='re'), missing as (select page_id, 'missing_operation' as problem, count(*) as n from claims where not exists (select 1 from ops where ops.page_id=claims.page_id and ops.ordinal=claims.ordinal) group by page_id), twice as (select page_id, 'several_owners' as problem, count(*) as n from (select page_id, ordinal from claims group by all having count(distinct g)>1) group by page_id) select * from missing union all select * from twice"))
def ownership(spark, sf):
    """The contract finds what is broken on purpose: strokes with two owners, owners of nothing."""
    ops = X.ops(spark, sf)
    name = lambda p: F.concat(F.lit(p), F.col("k").cast("string")).alias("group_id")
    claims = ops.where("operator <> 'n'").select("page_id", "ordinal", name("g")).unionByName(ops.where("operator = 'S'").select("page_id", "ordinal", name("h"))).unionByName(ops.where("operator = 're' and w >= 50").select("page_id", (F.col("ordinal") + 100000).alias("ordinal"), name("x")))
    groups = claims.select("page_id", "group_id", F.lit("group").alias("kind"), F.lit(None).cast("string").alias("parent_id")).distinct()
    return C.ownership(groups, claims, ops).select("page_id", "problem", "n")


@query("val_realization_scopes", X.twin("ops", f"with {DEPTH} select page_id, cast(min(depth) as bigint) as least, cast(sum(case when operator in {OPENS} then 1 when operator in {CLOSES} then -1 else 0 end) as bigint) as rest, count(*) filter (operator='Tj') as n_shown from d group by page_id"))
def realization_scopes(spark, sf):
    d = C.depth(X.ops(spark, sf))
    step = F.when(C.opens(), 1).when(C.closes(), -1).otherwise(0)
    return d.groupBy("page_id").agg(F.min("depth").cast("bigint").alias("least"), F.sum(step).cast("bigint").alias("rest"), F.count_if(F.col("operator") == "Tj").alias("n_shown"))


FRAME = "frames as (select page_id, k, min(x) as gx, min(y) as gy, max(y)-min(y) as gh from ops where operator in ('m','l','Tm','re') group by page_id, k)"


def frames(ops):
    return ops.where(C.is_in(["m", "l", "Tm", "re"])).groupBy("page_id", "k").agg(F.min("x").alias("gx"), F.min("y").alias("gy"), (F.max("y") - F.min("y")).alias("gh"))


@query("tr_localize", X.twin("ops", f"with {FRAME} select o.page_id, o.ordinal, case when operator in ('m','l','Tm','re','c') then x-gx end as lx, case when operator in ('m','l','Tm','re','c') then gy+gh-y-case when operator='re' then h else 0 end end as ly from ops o join frames f on f.page_id=o.page_id and f.k=o.k"))
def localize(spark, sf):
    ops = X.ops(spark, sf)
    own = ops.select("page_id", "ordinal", "k").join(frames(ops), ["page_id", "k"]).drop("k")
    return C.local(ops, own).select("page_id", "ordinal", "lx", "ly")


@query("tr_move_origin", X.twin("ops", f"with {FRAME} select o.page_id, o.ordinal, x - gx as x, y + (800 - gy - gh) as y from ops o join frames f on f.page_id=o.page_id and f.k=o.k where operator in ('Tm','re')"))
def move_origin(spark, sf):
    """Groups moved to their parent's origin: each text or rectangle operand shifted once."""
    ops = X.ops(spark, sf)
    j = ops.where(C.is_in(["Tm", "re"])).join(frames(ops), ["page_id", "k"]).dropDuplicates(["page_id", "ordinal"])
    return j.select("page_id", "ordinal", (F.col("x") - F.col("gx")).alias("x"), (F.col("y") + (800 - F.col("gy") - F.col("gh"))).alias("y"))


@query("agg_ctm_bbox", X.twin("ops", f"""with c as (select *, {lastv("'Tm'", "x")} as ex, {lastv("'Tm'", "y")} as ey from ops) select page_id, min(2*x+coalesce(ex,0)) as x, min(3*y+coalesce(ey,0)) as y, max(2*(x+w)+coalesce(ex,0)) as x2, max(3*(y+h)+coalesce(ey,0)) as y2 from c where operator='re' group by page_id"""))
def ctm_bbox(spark, sf):
    """Rectangles under a running matrix: scaled by 2 and 3, moved by the last text origin."""
    from leafloom.functions import box as B

    ops = X.ops(spark, sf).withColumn("ex", F.coalesce(C.last_of(["Tm"], "x"), F.lit(0.0))).withColumn("ey", F.coalesce(C.last_of(["Tm"], "y"), F.lit(0.0)))
    zero, one = F.lit(0.0), F.lit(1.0)
    m = B.times(B.matrix(one, zero, zero, one, F.col("ex"), F.col("ey")), B.matrix(F.lit(2.0), zero, zero, F.lit(3.0), zero, zero))
    p = ops.where("operator = 're'").withColumn("m", m).withColumn("a", B.move(F.col("m"), F.col("x"), F.col("y"))).withColumn("b", B.move(F.col("m"), F.col("x") + F.col("w"), F.col("y") + F.col("h")))
    return p.groupBy("page_id").agg(F.min("a.x").alias("x"), F.min("a.y").alias("y"), F.max("b.x").alias("x2"), F.max("b.y").alias("y2"))


@query("snk_serialize", X.twin("ops", "select page_id, string_agg(case when operator='re' then printf('%.1f %.1f %.1f %.1f re', x, y, w, h) when operator in ('m','l') then printf('%.1f %.1f %s', x, y, operator) else operator end, chr(10) order by ordinal) as stream from ops group by page_id"))
def serialize(spark, sf):
    return C.serialized(X.ops(spark, sf))


@query("snk_context_events", X.twin("ops", "with o as (select page_id, ordinal, k, operator in ('Tm','Tj','l','re') as inner_op, lag(k) over w as pk, lag(operator in ('Tm','Tj','l','re')) over w as pin from ops window w as (partition by page_id order by ordinal)) select page_id, ordinal, 'leave' as event, 'c'||pk as group_id from o where pk is not null and pin and not (k=pk and inner_op) union all select page_id, ordinal, 'leave', 'g'||pk from o where pk is not null and k<>pk union all select page_id, ordinal, 'enter', 'g'||k from o where pk is null or k<>pk union all select page_id, ordinal, 'enter', 'c'||k from o where inner_op and not coalesce(k=pk and pin, false)"))
def context_events(spark, sf):
    """Contexts to leave and to enter before each operation; groups hold an inner child for some of their operations."""
    k = F.col("k").cast("string")
    path = F.when(C.is_in(["Tm", "Tj", "l", "re"]), F.array(F.concat(F.lit("g"), k), F.concat(F.lit("c"), k))).otherwise(F.array(F.concat(F.lit("g"), k)))
    return C.contexts(X.ops(spark, sf).select("page_id", "ordinal", path.alias("path"))).drop("step")


@query("tr_operation_tree", X.twin("ops", "select page_id, k as node, min(ordinal) as first, count(*) as n_owned, cast(row_number() over (partition by page_id order by min(ordinal)) as bigint) as pos from ops where operator not in ('n','Q') group by page_id, k"))
def operation_tree(spark, sf):
    t = X.ops(spark, sf).where("operator not in ('n', 'Q')").groupBy("page_id", F.col("k").alias("node")).agg(F.min("ordinal").alias("first"), F.count("*").alias("n_owned"))
    return t.withColumn("pos", F.row_number().over(Window.partitionBy("page_id").orderBy("first")).cast("bigint"))


@query("tr_associate_text", X.twin("ops", f"""with {CLUSTERS}, st as (select *, {lastv("'Tf'", "w")} as fs, {lastv("'Tm'", "x")} as tx, {lastv("'Tm'", "y")} as ty from ops), t as (select page_id, ordinal, tx as x, ty as y, greatest(0.5*fs, 2.5*fs) as w, fs as h from st where operator in ('Tj','TJ')), m as (select t.page_id, t.ordinal, c.start, row_number() over (partition by t.page_id, t.ordinal order by (c.x2-c.x)*(c.y2-c.y), c.start) as turn from t join clusters c on c.page_id=t.page_id and t.x>=c.x-24 and t.y>=c.y-10 and t.x+t.w<=c.x2+24 and t.y+t.h<=c.y2+10) select page_id, ordinal, start as owner from m where turn=1"""))
def associate_text(spark, sf):
    """Shown text goes to the smallest cluster whose widened box holds it."""
    ops = materialize(X.ops(spark, sf), "ops")
    t = C.text_candidates(ops, 0.0).select("page_id", "ordinal", "x", (-F.col("y") - F.col("h")).alias("y"), "w", "h")
    c = C.clusters(C.marked_blocks(ops)).select("page_id", F.col("start").alias("owner"), F.col("x").alias("cx"), F.col("y").alias("cy"), "x2", "y2")
    hit = match.candidates(t, c, ["page_id"], F.expr("x >= cx - 24 and y >= cy - 10 and x + w <= x2 + 24 and y + h <= y2 + 10"))
    return match.best(hit, ["page_id", "ordinal"], F.expr("(x2 - cx) * (y2 - cy)"), "owner").select("page_id", "ordinal", "owner")
