"""The registered transforms, run in chains on whole tables, with SQL twins that follow the same rules stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom import fixtures as X
from leafloom import transforms
from leafloom.plans import query
from leafloom.plans.content import CLUSTERS, TEXT_SPANS, lastv
from leafloom.session import materialize, read

GROUPS = ["geometry.operations-into-groups.v1"]
TEXT = [*GROUPS, "layout.associate-text-operations.v1"]
WRAPPED = [*TEXT, "layout.expand-associated-content.v1"]
TABLES = [*WRAPPED, "layout.promote-content-groups-to-one-cell-tables.v1"]


def run(spark: SparkSession, sf: str, chain: list, nodes: bool = False) -> transforms.Tables:
    tables = {"ops": materialize(X.ops(spark, sf), "ops")}
    if nodes:
        tables = {"nodes": X.nodes(spark, sf)}
    return transforms.run(tables, {"transforms": chain})


# What each stage makes of the one before: groups and owned operations.
S0 = f"""with {CLUSTERS}, g0 as materialized (select page_id, 'geometry-' || page_id || '-' || start as group_id, cast(null as varchar) as parent_id, 'group' as kind, x, y, x2-x as w, y2-y as h, start, stop from clusters),
own0 as materialized (select b.page_id, g.group_id, cast(o as bigint) as ordinal from blocks b join g0 g on g.page_id=b.page_id and b.start>=g.start and b.stop<=g.stop, unnest(generate_series(b.start, b.stop)) u(o))"""
S1 = f"""{S0}, {TEXT_SPANS}, st as (select *, {lastv("'Tf'", "w")} as fs, {lastv("'Tm'", "x")} as tx, {lastv("'Tm'", "y")} as ty from ops), shown as (select page_id, ordinal, tx, ty, 2.5*fs as tw, fs as th from st where operator in ('Tj','TJ')),
won as (select * from (select t.*, g.group_id as owner, row_number() over (partition by t.page_id, t.ordinal order by g.w*g.h, g.group_id) as turn from shown t join g0 g on g.page_id=t.page_id and tx>=g.x-24 and ty>=g.y-10 and tx+tw<=g.x+g.w+24 and ty+th<=g.y+g.h+10) where turn=1),
kids as materialized (select page_id, owner || '-text-' || ordinal as group_id, owner as parent_id, 'text_operations' as kind, tx as x, ty as y, tw as w, th as h, ordinal from won), g1 as (select page_id, group_id, parent_id, kind, x, y, w, h from g0 union all select page_id, group_id, parent_id, kind, x, y, w, h from kids),
new1 as (select distinct k.page_id, k.group_id, cast(o as bigint) as ordinal from kids k join text_spans s using (page_id, ordinal), unnest(generate_series(s.start, s.stop)) u(o)), own1 as materialized (select * from own0 where not exists (select 1 from new1 n where n.page_id=own0.page_id and n.ordinal=own0.ordinal) union all select * from new1)"""
S2 = f"""{S1}, grown as (select r.page_id, r.group_id, min(least(r.x, k.x)) as x, min(least(r.y, k.y)) as y, max(greatest(r.x+r.w, k.x+k.w)) as x2, max(greatest(r.y+r.h, k.y+k.h)) as y2 from g0 r join kids k on k.page_id=r.page_id and k.parent_id=r.group_id group by r.page_id, r.group_id),
g2 as materialized (select g.page_id, g.group_id, case when g.parent_id is null and r.group_id is not null then g.group_id || '-wrapper' else g.parent_id end as parent_id, kind, g.x, g.y, w, h from g1 g left join grown r on r.page_id=g.page_id and r.group_id=g.group_id union all select page_id, group_id || '-wrapper', null, 'content_group', x, y, x2-x, y2-y from grown)"""
S3 = f"""{S2}, g3 as materialized (select page_id, group_id, case when parent_id like '%-wrapper' then parent_id || '::cell' else parent_id end as parent_id, case when kind='content_group' then 'table' else kind end as kind, x, y, w, h from g2 union all select page_id, group_id || '::cell', group_id, 'cell', x, y, w, h from g2 where kind='content_group')"""
PATHS = "p as (select page_id, group_id, group_id as root, 0 as depth, [group_id] as path from {0} where parent_id is null union all select g.page_id, g.group_id, p.root, p.depth+1, list_append(p.path, g.group_id) from {0} g join p on p.page_id=g.page_id and g.parent_id=p.group_id)"
COLUMNS = "page_id, group_id, parent_id, kind, x, y, w, h"


def recursive(names: str, body: str) -> str:
    return X.twin(names, body).replace("with ", "with recursive ", 1)


def groups(out: transforms.Tables) -> DataFrame:
    return out["groups"].select(*COLUMNS.split(", "))


@query("reg_identity", X.twin("nodes", "select node_no, node_id, page_id, type, x, y, w, h, text from nodes"))
def identity(spark, sf):
    return run(spark, sf, ["identity.v1"], nodes=True)["nodes"].select("node_no", "node_id", "page_id", "type", "x", "y", "w", "h", "text")


@query("reg_project", "select rec_id, page_id, media_box[3] - media_box[1] as width, media_box[4] - media_box[2] as height from renderable_pages where len(media_box) = 4 and media_box[3] > media_box[1] and media_box[4] > media_box[2]")
def project(spark, sf):
    """Pages with a usable box; nodes start empty."""
    out = transforms.run({"pages": read(spark, sf, "renderable_pages"), "nodes": X.nodes(spark, sf)}, {"transforms": ["project.pdf-ir.v1"]})
    m = lambda k: F.get("media_box", F.lit(k))
    return out["pages"].join(out["nodes"].select("page_id"), "page_id", "left_anti").select("rec_id", "page_id", (m(2) - m(0)).alias("width"), (m(3) - m(1)).alias("height"))


@query("reg_font_catalog", X.twin("ops", "select case when w=3 then 4 else w end as font, count(*) as n_used, count(distinct page_id) as n_pages, min(page_id) as first_page from ops where operator='Tf' group by 1"))
def font_catalog(spark, sf):
    return run(spark, sf, [{"id": "font.catalog.v1", "options": {"resource_mapping": {"3": 4}}}])["fonts"]


@query("reg_rule_sections", X.twin("nodes", "with r as (select page_id, cast(y as double) as at, max(node_id) as section from nodes where type='rule' and w >= 20.0*h group by page_id, y), n as (select page_id, node_id, y + h/2 as at, x, y, w, h from nodes where not (type='rule' and w >= 20.0*h)), placed as (select n.*, coalesce((select arg_max(r.section, r.at) from r where r.page_id=n.page_id and r.at<=n.at), 'top') as section from n) select page_id, 'section-' || page_id || '-' || section as group_id, cast(min(x) as double) as x, cast(min(y) as double) as y, cast(max(x+w)-min(x) as double) as w, cast(max(y+h)-min(y) as double) as h, count(*) as n_nodes from placed group by page_id, section"))
def rule_sections(spark, sf):
    out = run(spark, sf, ["group.horizontal-rules.v1"], nodes=True)
    n = out["node_sections"].groupBy("page_id", "group_id").agg(F.count("*").alias("n_nodes"))
    return out["groups"].join(n, ["page_id", "group_id"]).select("page_id", "group_id", "x", "y", "w", "h", "n_nodes")


@query("reg_operation_groups", X.twin("ops", f"{S0} select page_id, group_id, x, y, w, h, list_sum(ords) as sum_ordinals, len(ords) as n_owned from g0 join (select page_id, group_id, list(ordinal) as ords from own0 group by page_id, group_id) using (page_id, group_id)"))
def operation_groups(spark, sf):
    out = run(spark, sf, GROUPS)
    own = out["group_ops"].groupBy("page_id", "group_id").agg(F.sum("ordinal").alias("sum_ordinals"), F.count("*").alias("n_owned"))
    return out["groups"].join(own, ["page_id", "group_id"]).select("page_id", "group_id", "x", "y", "w", "h", "sum_ordinals", "n_owned")


@query("reg_associate_text", X.twin("ops", f"{S1} select page_id, group_id, ordinal from own1"))
def associate_text(spark, sf):
    """Who owns which operation once shown text has moved to its new group."""
    return run(spark, sf, TEXT)["group_ops"].select("page_id", "group_id", "ordinal")


@query("reg_text_groups", X.twin("ops", f"{S1} select {COLUMNS} from g1"))
def text_groups(spark, sf):
    return groups(run(spark, sf, TEXT))


@query("reg_expand_content", X.twin("ops", f"{S2} select {COLUMNS} from g2"))
def expand_content(spark, sf):
    return groups(run(spark, sf, WRAPPED))


@query("reg_one_cell_tables", X.twin("ops", f"{S3} select {COLUMNS} from g3"))
def one_cell_tables(spark, sf):
    return groups(run(spark, sf, TABLES))


@query("reg_inject_lines", X.twin("ops", f"{S3}, c as (select page_id, min(group_id) as group_id from g3 where kind='cell' group by page_id), b as (select c.page_id, c.group_id, g.x, g.y from c join g3 g using (page_id, group_id)), l as (select page_id, max(ordinal) as last from ops group by page_id) select b.page_id, b.group_id, cast(last + 1 + 5*i + j as bigint) as ordinal, ['BT','Tf','Tm','Tj','ET'][j+1] as operator, b.x, b.y - 14.0*i as y from b join l using (page_id), unnest(generate_series(0, 5)) u(i), unnest(generate_series(0, 4)) v(j)"))
def inject_lines(spark, sf):
    """The operations that were put in, with their owners."""
    out = run(spark, sf, [*TABLES, "evaluation.inject-six-lines-into-first-cell.v1"])
    old = X.ops(spark, sf).groupBy("page_id").agg(F.max("ordinal").alias("last"))
    new = out["ops"].join(old, "page_id").where("ordinal > last")
    return new.join(out["group_ops"], ["page_id", "ordinal"]).select("page_id", "group_id", "ordinal", "operator", "x", "y")


@query("reg_growth", recursive("ops", f"{S3}, {PATHS.format('g3')}, sub as (select g.page_id, a.node as group_id, min(g.x) as gx, min(g.y) as gy, max(g.x+g.w) as gx2, max(g.y+g.h) as gy2 from g3 g join p using (page_id, group_id), unnest(p.path) a(node) group by g.page_id, a.node), j as (select g.*, gx, gy, gx2, gy2, kind in ('table','cell') and (gx<x or gy<y or gx2>x+w or gy2>y+h) as grows from g3 g join sub using (page_id, group_id)) select page_id, group_id, kind, case when grows then gx-2 else x end as x, case when grows then gy-2 else y end as y, case when grows then gx2-gx+4 else w end as w, case when grows then gy2-gy+4 else h end as h from j"))
def growth(spark, sf):
    out = run(spark, sf, [*TABLES, {"id": "layout.intrinsic-container-growth.v1", "options": {"padding": 2}}])
    return groups(out).drop("parent_id")


@query("reg_operation_tree", recursive("ops", f"{S1}, {PATHS.format('g1')}, f as (select o.page_id, a.node, min(o.ordinal) as first from own1 o join p using (page_id, group_id), unnest(p.path) a(node) group by o.page_id, a.node), e as (select page_id, node, first, 'operation_group' as kind from f union all select page_id, 'op-' || ordinal, ordinal, 'operation' from ops where not exists (select 1 from own1 w where w.page_id=ops.page_id and w.ordinal=ops.ordinal)) select page_id, node, kind, first, row_number() over (partition by page_id order by first, kind desc, node) as position from e"))
def operation_tree(spark, sf):
    return run(spark, sf, [*TEXT, "layout.materialize-operation-tree.v1"])["tree"].select("page_id", "node", "kind", "first", "position")


@query("reg_move_to_parent", X.twin("ops", f"{S1}, d as (select k.page_id, k.group_id, g.x-k.x as dx, g.y-k.y as dy from kids k join g0 g on g.page_id=k.page_id and g.group_id=k.parent_id) select o.page_id, o.ordinal, o.operator, o.x + dx as x, o.y + dy as y from ops o join own1 using (page_id, ordinal) join d using (page_id, group_id) where o.operator in ('Tm','re')"))
def move_to_parent(spark, sf):
    """Text and rectangle operands that moved with their groups to the parent's origin."""
    out = run(spark, sf, [*TEXT, "geometry.move-groups-to-parent-origin.v1"])
    text = out["groups"].where("parent_id is not null").select("page_id", "group_id")
    own = out["group_ops"].join(text, ["page_id", "group_id"], "left_semi")
    return out["ops"].where("operator in ('Tm', 're')").join(own, ["page_id", "ordinal"]).select("page_id", "ordinal", "operator", "x", "y")


@query("reg_localize", X.twin("ops", f"{S1} select o.page_id, o.ordinal, case when operator in ('m','l','Tm','re','c') then o.x-g.x end as lx, case when operator in ('m','l','Tm','re','c') then g.y+g.h-o.y-case when operator='re' then o.h else 0 end end as ly from ops o join own1 using (page_id, ordinal) join g1 g using (page_id, group_id)"))
def localize(spark, sf):
    return run(spark, sf, [*TEXT, "geometry.localize-operation-groups.v1"])["local_ops"].select("page_id", "ordinal", "lx", "ly")


@query("reg_relative", X.twin("ops", f"{S2}, r as (select g.*, g.x - coalesce(q.x, 0) as rx, g.y - coalesce(q.y, 0) as ry from g2 g left join g2 q on q.page_id=g.page_id and q.group_id=g.parent_id) select page_id, group_id, rx, ry, x - coalesce(lag(x) over (partition by page_id, parent_id order by group_id), 0) as dx, y - coalesce(lag(y) over (partition by page_id, parent_id order by group_id), 0) as dy from r where x is not null"))
def relative(spark, sf):
    return run(spark, sf, [*WRAPPED, "layout.relative-coordinates.v1"])["relative"]


@query("reg_debug_groups", recursive("ops", f"{S3}, {PATHS.format('g3')} select page_id, group_id, cast(depth as bigint) as depth, round(greatest(0.75, 0.96 - 0.06*depth), 6) as fill_gray from p"))
def debug_groups(spark, sf):
    o = run(spark, sf, [*TABLES, "debug.visualize-groups.v1"])["overlays"]
    return o.select("page_id", "group_id", F.col("depth").cast("bigint").alias("depth"), F.round("fill_gray", 6).alias("fill_gray"))


@query("reg_unprocessed", X.twin("ops", f"{S1}, sp as (select page_id, k, max(case when operator='BT' then 1 else 0 end) as is_text, min(ordinal) as first, max(ordinal) as last, count(*) as n, max(case when operator='re' then greatest(w,h) end) as long, max(case when operator='re' then least(w,h) end) as thin from ops where operator in ('BT','Tf','Tm','Tj','ET','m','l','S','re','f*') group by page_id, k) select page_id, first, last, n, case when is_text=1 then 'text_content_candidate' when long is null then 'radical_or_geometry_stroke_candidate' when long>=6 and thin<=2.5 then 'thin_rule_or_fraction_bar_candidate' else 'filled_geometry_candidate' end as class from sp where (select count(*) from own1 w where w.page_id=sp.page_id and w.ordinal between sp.first and sp.last) < n"))
def unprocessed(spark, sf):
    return run(spark, sf, [*TEXT, "diagnostics.unprocessed-items.v1"])["unprocessed"].select("page_id", "first", "last", "n", "class")


@query("reg_translation_units", X.twin("nodes", "with n as (select * from nodes where type in ('text_band','text_fragment','heading','caption') and trim(coalesce(text,''))<>''), u as (select *, row_number() over (partition by page_id order by y, node_no) as pos from n) select page_id, page_id || '-text-' || lpad(cast(pos as varchar), 5, '0') as unit_id, pos, node_id, text, 'de' as target_language from u"))
def translation_units(spark, sf):
    return run(spark, sf, [{"id": "translation.project.v1", "options": {"target_language": "de"}}], nodes=True)["units"].withColumn("pos", F.col("pos").cast("bigint"))


@query("reg_native_tables", X.twin("ops", "with r as (select page_id, ordinal as opened, ordinal + 4 as closed, k, row_number() over (partition by page_id order by ordinal) as turn from ops where operator='BDC'), c as (select r.page_id, r.opened, min(o.x) as x, min(o.y) as y, max(o.x)-min(o.x) as w, max(o.y)-min(o.y) as h from r join ops o on o.page_id=r.page_id and o.ordinal between opened and closed and operator in ('m','l','re') group by r.page_id, r.opened) select page_id, 'table' as group_id, cast(null as varchar) as parent_id, 'table' as kind, cast(null as double) as x, cast(null as double) as y, cast(null as double) as w, cast(null as double) as h from c group by page_id union all select page_id, 'row', 'table', 'row', null, null, null, null from c group by page_id union all select page_id, 'cell-' || opened, 'row', 'cell', x, y, w, h from c"))
def native_tables(spark, sf):
    """A table with one row on each page that has marked content; each piece of it is a cell."""
    ops = materialize(X.ops(spark, sf), "ops")
    marked = ops.where("operator = 'BDC'")
    none = F.lit(None).cast("string")
    top = marked.select("page_id").distinct()
    tree = lambda df, i, up, role, mcid: df.select("page_id", i.alias("node_id"), up.alias("parent_id"), F.lit(role).alias("role"), mcid.cast("bigint").alias("mcid"))
    s = tree(top, F.lit("table"), none, "/Table", F.lit(None)).unionByName(tree(top, F.lit("row"), F.lit("table"), "/TR", F.lit(None))).unionByName(tree(marked, F.concat(F.lit("cell-"), F.col("ordinal").cast("string")), F.lit("row"), "/TD", F.col("ordinal")))
    return groups(transforms.run({"ops": ops, "structure": s}, {"transforms": ["structure.materialize-native-tables.v1"]}))
