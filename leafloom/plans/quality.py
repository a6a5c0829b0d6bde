"""The promotion gate and its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafloom import fixtures as X
from leafloom.functions.box import box
from leafloom.operators import quality as Q
from leafloom.plans import query
from leafloom.session import materialize, read

TEXT = "('text_band','text_fragment','heading','caption','page_number','header','footer')"
RANGES = "(values ('body',8,60),('heading',12,70),('note',6,50),('formula',8,80)) r(class, lo, hi)"
INTER = "greatest(0, least(a.x+a.w, b.x+b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y+a.h, b.y+b.h) - greatest(a.y, b.y))"
PARTS = f"""with bounds as (select n.page_id, n.node_id, 'bbox_bounds' as "check", 'error' as severity, cast(case when w<=0 or h<=0 then 1 else 2 end as double) as value from nodes n left join page_sizes p on p.page_id=n.page_id where w<=0 or h<=0 or x<0 or y<0 or x+w>width or y+h>height),
classes as (select page_id, node_id, 'class_height' as "check", 'review' as severity, cast(h as double) as value from nodes n join {RANGES} on r.class=n.class where h<lo or h>hi),
breaks as (select page_id, node_id, 'line_break_field' as "check", case when coalesce(contains(text, chr(10)) or contains(text, '\\n'), false) then 'error' else 'review' end as severity, cast(1 as double) as value from nodes where coalesce(contains(text, chr(10)) or contains(text, '\\n'), false) or coalesce(contains(latex, chr(10)) or contains(latex, '\\n'), false)),
rel as (select distinct node_id, unnest(relation_targets) as target from page_nodes),
covered as (select page_id, node_id, 'mask_intersection' as "check", 'review' as severity, part as value from (select a.page_id, a.node_id, b.node_id as obstacle, round({INTER} * 1.0 / (a.w*a.h), 4) as part from solid a join obstacles b on a.page_id=b.page_id and {INTER} > 0 where a.type in {TEXT}) t where part >= 0.05 and not exists (select 1 from rel where rel.node_id=t.node_id and rel.target=t.obstacle)),
dup as (select page_id, node_id, 'duplicate_bbox' as "check", 'review' as severity, round(i, 4) as value from (select a.page_id, a.node_id, ({INTER}) * 1.0 / (a.w*a.h + b.w*b.h - {INTER}) as i from solid a join solid b on a.page_id=b.page_id and a.type=b.type and a.node_no<b.node_no where a.type in {TEXT} or a.type in ('equation','image','diagram_component','table')) t where i >= 0.98)"""
LAST = "(select * from (select *, row_number() over (partition by node_id order by node_no desc) as turn from {0}) where turn = 1)"
DIFF = f"""diff as (select coalesce(a.node_id, c.node_id) as node_id, case when c.node_id is null then 'removed' when a.node_id is null then 'added' when a.type<>c.type or a.class<>c.class or greatest(abs(a.x-c.x),abs(a.y-c.y),abs(a.w-c.w),abs(a.h-c.h))>2 then 'changed' else 'same' end as status, coalesce(a.type, c.type) as type, greatest(abs(a.x-c.x),abs(a.y-c.y),abs(a.w-c.w),abs(a.h-c.h)) as moved from {LAST.format("solid")} a full join {LAST.format("candidate")} c on a.node_id=c.node_id)"""
VALUABLE = "('equation','image','diagram_component','table','text_band','text_fragment','heading','caption')"


def gate_nodes(spark, sf):
    """The nodes as the gate needs them, once each: of the texts only whether they hold line ends. Written once, as all checks read them."""
    raw = read(spark, sf, "page_nodes").where("bbox is not null")
    slim = raw.select("node_no", "node_id", "page_id", "book_id", F.coalesce("node_type", F.lit("")).alias("type"), F.coalesce("node_class", F.lit("")).alias("class"), "bbox.x", "bbox.y", "bbox.w", "bbox.h", F.xxhash64("text", "latex").alias("texts"), Q.broken(F.col("text")).alias("text_breaks"), Q.broken(F.col("latex")).alias("latex_breaks"), "confidence")
    return materialize(slim.distinct(), "gate-nodes").withColumn("b", box(F.col("x"), F.col("y"), F.col("w"), F.col("h")))


def parts(spark, sf, n=None):
    n = X.nodes(spark, sf) if n is None else n
    s = n.where("w > 0 and h > 0")
    obstacles = s.where(F.col("type").isin(*Q.OBSTACLE_TYPES))
    relations = read(spark, sf, "page_nodes").where("size(relation_targets) > 0").select("node_id", F.explode("relation_targets").alias("target")).distinct()
    return {"bounds": Q.bounds(n, X.page_sizes(spark, sf)), "classes": Q.class_ranges(n), "breaks": Q.line_breaks(n), "covered": Q.covered_text(s, obstacles, relations), "dup": Q.duplicates(s)}


for _name, _key in (("val_bbox_bounds", "bounds"), ("val_class_ranges", "classes"), ("val_line_breaks", "breaks"), ("jn_text_obstacle", "covered"), ("jn_duplicate_iou", "dup")):
    query(_name, X.twin("nodes solid obstacles page_sizes", f"{PARTS} select * from {_key}"))(lambda spark, sf, key=_key: parts(spark, sf)[key])


@query("jn_baseline_diff", X.twin("solid candidate", f"with {DIFF} select * from diff"))
def baseline_diff(spark, sf):
    return Q.difference(X.solid(spark, sf), X.candidate(spark, sf))


@query("set_added_removed", X.twin("solid candidate", "select status, count(*) as n from (select node_id, 'removed' as status from (select distinct node_id from solid except select distinct node_id from candidate) union all select node_id, 'added' from (select distinct node_id from candidate except select distinct node_id from solid)) group by status"))
def added_removed(spark, sf):
    a, b = X.solid(spark, sf).select("node_id").distinct(), X.candidate(spark, sf).select("node_id").distinct()
    return a.exceptAll(b).withColumn("status", F.lit("removed")).unionByName(b.exceptAll(a).withColumn("status", F.lit("added"))).groupBy("status").agg(F.count("*").alias("n"))


GATE = f"""{PARTS}, {DIFF}, reg as (select node_id, status from diff where status='removed' and type in {VALUABLE}),
every as (select "check", severity from bounds union all select "check", severity from classes union all select "check", severity from breaks union all select "check", severity from covered union all select "check", severity from dup union all select 'regression', 'error' from reg)
select coalesce("check",'all') as "check", coalesce(severity,'all') as severity, count(*) as n, case when count(*) filter (severity='error')>0 then 'fail' when count(*)>0 then 'review' else 'pass' end as status from every group by rollup("check", severity)"""


@query("agg_quality_rollup", X.twin("nodes solid obstacles page_sizes candidate", GATE))
def quality_rollup(spark, sf):
    n = gate_nodes(spark, sf)
    solid = n.where("w > 0 and h > 0")
    lost = Q.regressions(Q.difference(solid, X.candidate_of(solid)))
    return Q.gate([*parts(spark, sf, n).values(), lost])
