"""Document structure, page images, fonts and translation, rendering, pipelines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafloom import fixtures as X
from leafloom.functions import box as B
from leafloom.functions import text as T
from leafloom.operators import image as I
from leafloom.operators import render, structure
from leafloom.plans import query
from leafloom.session import read

OUTLINE = r"""outline as (select book_id, node_id, row_number() over (partition by book_id order by page_id, y, node_no) as entry_no, regexp_extract(text, '^([0-9]+(\.[0-9]+)*)', 1) as section, trim(regexp_replace(text, '^[0-9.]+', '')) as title, cast(regexp_extract(page_id, '-p([0-9]+)$', 1) as bigint) as page from nodes where type='heading' and text is not null and book_id is not null), leveled as (select *, case when regexp_full_match(section, '[0-9]+(\.[0-9]+)*') then length(section)-length(replace(section,'.',''))+1 else 1 end as level from outline)"""


def outline(spark, sf):
    h = X.nodes(spark, sf).where("type = 'heading' and text is not null and book_id is not null")
    w = Window.partitionBy("book_id").orderBy("page_id", "y", "node_no")
    section = F.regexp_extract("text", r"^([0-9]+(\.[0-9]+)*)", 1)
    e = h.select("book_id", "node_id", F.row_number().over(w).cast("bigint").alias("entry_no"), section.alias("section"), F.trim(F.regexp_replace("text", "^[0-9.]+", "")).alias("title"), F.regexp_extract("page_id", "-p([0-9]+)$", 1).cast("bigint").alias("page"))
    return e.withColumn("level", T.outline_level(F.col("section"), F.lit(None).cast("bigint")))


@query("fn_outline_levels", X.twin("nodes", f"with {OUTLINE} select node_id, cast(level as bigint) as level, trim(section || ' ' || title) as label from leveled"))
def outline_levels(spark, sf):
    return outline(spark, sf).select("node_id", "level", F.trim(F.concat_ws(" ", "section", "title")).alias("label"))


@query("isl_active_outline", X.twin("nodes", f"with {OUTLINE}, pages as (select distinct book_id, page from outline), l as (select p.book_id, p.page, e.level, max(e.entry_no) as entry_no from pages p join leveled e on e.book_id=p.book_id and e.page<=p.page group by p.book_id, p.page, e.level) select l.book_id, l.page, cast(l.level as bigint) as level, l.entry_no, e.title from l join leveled e on e.book_id=l.book_id and e.entry_no=l.entry_no where not exists (select 1 from l s where s.book_id=l.book_id and s.page=l.page and s.level<l.level and s.entry_no>l.entry_no)"))
def active_outline(spark, sf):
    e = outline(spark, sf)
    return structure.active_outline(e, e.select("book_id", "page").distinct()).select("book_id", "page", "level", "entry_no", "title")


@query("fn_running_header", X.twin("nodes", f"with {OUTLINE}, pages as (select distinct book_id, page from outline), l as (select p.book_id, p.page, max(e.entry_no) filter (e.level=1) as top, max(e.entry_no) as last from pages p join leveled e on e.book_id=p.book_id and e.page<=p.page group by p.book_id, p.page) select l.book_id, l.page, coalesce(nullif(t.title,''), nullif(a.title,''), b.title) as header from l left join leveled t on t.book_id=l.book_id and t.entry_no=l.top left join leveled a on a.book_id=l.book_id and a.entry_no=l.last left join books b on b.book_id=l.book_id"))
def running_header(spark, sf):
    """The last first-level title up to the page, else the last title of any level, else the book's."""
    e = outline(spark, sf)
    pages = e.select("book_id", "page").distinct()
    j = pages.join(e.select("book_id", "entry_no", "level", F.col("page").alias("at_page"), "title"), "book_id").where("at_page <= page")
    one = j.groupBy("book_id", "page").agg(F.max_by("title", F.when(F.col("level") == 1, F.col("entry_no"))).alias("top"), F.max_by("title", "entry_no").alias("last"))
    return one.join(read(spark, sf, "books").select("book_id", F.col("title").alias("book_title")), "book_id", "left").select("book_id", "page", F.coalesce(F.nullif("top", F.lit("")), F.nullif("last", F.lit("")), "book_title").alias("header"))


PAGES = "pages as (select page_id, max(book_id) as book_id, max(source_page_index) as source_index from renderable_pages where page_id is not null group by page_id), labels as (select page_id, label from (select n.page_id, trim(n.text) as label, row_number() over (partition by n.page_id order by n.y desc, n.x desc, trim(n.text) desc, n.node_id desc) as turn from nodes n where regexp_full_match(trim(n.text), '[0-9]{1,5}')) where turn=1), known as (select p.*, l.label, try_cast(l.label as bigint) as number from pages p left join labels l on l.page_id=p.page_id), offs as (select book_id, number-source_index as off, count(*) as c from known where number is not null group by 1, 2), usual as (select book_id, off from (select *, row_number() over (partition by book_id order by c desc, off) as turn from offs) where turn=1), page_map as (select k.page_id, k.book_id, k.source_index, k.label, coalesce(number, source_index+off) as printed from known k left join usual u on u.book_id=k.book_id)"


def page_map(spark, sf):
    p = read(spark, sf, "renderable_pages").where("page_id is not null").groupBy("page_id").agg(F.max("book_id").alias("book_id"), F.max("source_page_index").alias("source_index"))
    n = X.nodes(spark, sf).withColumn("label", F.trim("text")).where(F.col("label").rlike("^[0-9]{1,5}$"))
    labels = n.groupBy("page_id").agg(F.max_by("label", F.struct("y", "x", "label", "node_id")).alias("label"))
    return structure.page_map(p, labels)


@query("agg_page_map", X.twin("nodes", f"with {PAGES} select * from page_map"))
def page_map_query(spark, sf):
    return page_map(spark, sf)


@query("tr_header_footer", X.twin("nodes", f"with {PAGES} select m.page_id, m.page_id || '-generated-' || r.kind || '-' || lpad(cast(row_number() over (partition by m.page_id, r.kind order by r.template) as varchar), 2, '0') as node_id, replace(replace(r.template, '{{printed_page}}', coalesce(cast(m.printed as varchar), '')), '{{running_header}}', coalesce(b.title, '')) as text from page_map m join (values ('even','header','{{printed_page}} | {{running_header}}'),('odd','header','{{running_header}} | {{printed_page}}'),('even','footer','- {{printed_page}} -'),('odd','footer','- {{printed_page}} -')) r(side, kind, template) on r.side = case when m.printed%2=0 then 'even' else 'odd' end left join books b on b.book_id=m.book_id"))
def header_footer(spark, sf):
    rules = spark.createDataFrame([("even", "header", "{printed_page} | {running_header}"), ("odd", "header", "{running_header} | {printed_page}"), ("even", "footer", "- {printed_page} -"), ("odd", "footer", "- {printed_page} -")], "side string, kind string, template string")
    m = page_map(spark, sf).join(read(spark, sf, "books").select("book_id", F.col("title").alias("header")), "book_id", "left")
    return structure.furniture(m, rules)


@query("jn_outline_match_exact", X.twin("nodes", f"with {OUTLINE}, t as (select node_id, book_id, trim(regexp_replace(upper(regexp_replace(text, '[^ -~]', '', 'g')), '[^0-9A-Z]+', ' ', 'g')) as norm from nodes where type in ('text_band','text_fragment') and text is not null), o as (select book_id, entry_no, trim(regexp_replace(upper(regexp_replace(title, '[^ -~]', '', 'g')), '[^0-9A-Z]+', ' ', 'g')) as norm from outline) select t.node_id, min(o.entry_no) as entry_no from t join o on o.book_id=t.book_id and o.norm=t.norm and t.norm<>'' group by t.node_id"))
def outline_match_exact(spark, sf):
    plain = lambda c: T.normalized_ascii(F.regexp_replace(c, "[^ -~]", ""))
    t = X.nodes(spark, sf).where("type in ('text_band', 'text_fragment') and text is not null").select("node_id", "book_id", plain("text").alias("norm")).where("norm <> ''")
    o = outline(spark, sf).select("book_id", "entry_no", plain("title").alias("norm"))
    return t.join(o, ["book_id", "norm"]).groupBy("node_id").agg(F.min("entry_no").alias("entry_no"))


@query("tr_classify_headings")
def classify_headings(spark, sf):
    """Headings matched to the outline of their own book, with scores; similarity has no SQL twin."""
    n = X.nodes(spark, sf).where("type = 'heading' and book_id is not null").select("node_id", "book_id", "text")
    return structure.headings(n, outline(spark, sf).select("book_id", "entry_no", "section", "title"), 0.78)


# images from the vectors: 8 x 8 pixels


def images(spark, sf):
    """Each vector as a little image: darker where it is larger."""
    level = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.bround(128 - v * 400))).cast("int"))
    hexed = F.array_join(F.transform(level, lambda v: F.lpad(F.hex(v), 2, "0")), "")
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("page_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.unhex(hexed).alias("data"))


PIX = "pix as (select vec_id as page_id, cast(floor((i-1)/8) as bigint) as y, cast((i-1)%8 as bigint) as x, greatest(0, least(255, round_even(128 - cast(embedding[i] as float)*400, 0))) as v from embeddings, unnest(generate_series(1, 64)) u(i))"


@query("img_content_box", f"with {PIX} select page_id, coalesce(min(case when v<110 then x end), 0) as x, coalesce(min(case when v<110 then y end), 0) as y, coalesce(max(case when v<110 then x end)-min(case when v<110 then x end)+1, 8) as w, coalesce(max(case when v<110 then y end)-min(case when v<110 then y end)+1, 8) as h from pix group by page_id")
def content_box(spark, sf):
    return I.per_image(images(spark, sf), lambda a: [I.content_box(a, 110)], "x bigint, y bigint, w bigint, h bigint")


@query("img_row_runs", f"with {PIX}, r as (select page_id, y from pix group by page_id, y having count(*) filter (v<120)>=3), g as (select page_id, y, y - row_number() over (partition by page_id order by y) as g from r) select page_id, min(y) as start, max(y)+1 as stop from g group by page_id, g")
def row_runs(spark, sf):
    return I.per_image(images(spark, sf), lambda a: I.runs((a < 120).sum(axis=1) >= 3), "start bigint, stop bigint")


@query("agg_otsu", f"with {PIX}, h as (select page_id, cast(v as bigint) as v, count(*) as n from pix group by page_id, v), c as (select page_id, v, sum(n) over w as b, sum(n*v) over w as m, sum(n) over (partition by page_id) as t, sum(n*v) over (partition by page_id) as tm from h window w as (partition by page_id order by v)) select page_id, cast(arg_max(v, (s, -v)) as bigint) as threshold from (select page_id, v, round(power(tm*1.0*b/t - m, 2)/(b*(t-b)), 6) as s from c where b<t) group by page_id")
def otsu(spark, sf):
    return I.per_image(images(spark, sf), lambda a: [(I.otsu(a),)], "threshold bigint")


@query("img_components")
def components(spark, sf):
    return I.per_image(images(spark, sf), lambda a: I.components(a < 120, 2), "x bigint, y bigint, w bigint, h bigint, area bigint")


@query("img_density", f"with {PIX}, d as (select page_id, y, count(*) filter (v<120)/8.0 as d from pix group by page_id, y) select page_id, max(d) as most, min(d) as least, avg(d) as mean from d group by page_id")
def density(spark, sf):
    import numpy as np

    def kernel(a):
        d = (a < 120).mean(axis=1)
        return [(float(d.max()), float(d.min()), float(np.mean(d)))]

    return I.per_image(images(spark, sf), kernel, "most double, least double, mean double")


# fonts and translation


@query("fn_cmap_decode", "with t as (select o_orderkey as id, upper(hex(substr(o_orderpriority, 3))) as codes from orders), u as (select id, i, substr(codes, cast(i*2-1 as int), 2) as code from t, unnest(generate_series(1, length(codes)//2)) u(i)), m as (select distinct code, case when code in ('20','2D') then null else chr(cast(('0x' || code) as int)) end as ch from u) select u.id, string_agg(coalesce(m.ch, chr(65533)), '' order by i) as text, count(*) filter (m.ch is null) as n_unknown from u join m using (code) group by u.id")
def cmap_decode(spark, sf):
    """Fixed-width codes through a map; unknown ones become the replacement character."""
    t = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.hex(F.expr("substring(o_orderpriority, 3)")).alias("codes")).where("length(codes) >= 2")
    each = t.select("id", F.explode(F.sequence(F.lit(0), (F.length("codes") / 2).cast("int") - 1)).alias("i"), "codes").select("id", "i", F.expr("substring(codes, 2 * i + 1, 2)").alias("code"))
    known = each.select("code").distinct().where("code not in ('20', '2D')").select("code", F.char(F.conv("code", 16, 10).cast("bigint")).alias("ch"))
    j = each.join(F.broadcast(known), "code", "left")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("ch", F.lit("�")).alias("ch")))), lambda s: s["ch"]), "")
    return j.groupBy("id").agg(text.alias("text"), F.count_if(F.col("ch").isNull()).alias("n_unknown"))


@query("fn_hex_text", "select p_partkey as id, chr(65 + cast(p_partkey%26 as int)) || chr(945 + cast(p_partkey%24 as int)) as wide from part")
def hex_text(spark, sf):
    """UTF-16 codes in hexadecimal read back as text."""
    code = lambda base, n: F.lpad(F.hex(F.lit(base) + F.col("p_partkey") % n), 4, "0")
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.hex_text(F.concat(code(65, 26), code(945, 24))).alias("wide"))


@query("fn_font_family", "select p_partkey as id, 'Font' || p_partkey || case when p_partkey%4=2 then '-Semi' when p_partkey%4=3 then '-Text' else '' end as family, case when p_partkey%4=1 then 'Bold' when p_partkey%4=2 then 'Italic' end as style, case when p_partkey%2=0 then 'ABCDEF' end as subset from part")
def font_family(spark, sf):
    k = F.col("p_partkey")
    base = F.concat(F.lit("/"), F.when(k % 2 == 0, "ABCDEF+").otherwise(""), F.lit("Font"), k.cast("string"), F.when(k % 4 == 0, "").when(k % 4 == 1, "-Bold").when(k % 4 == 2, "-Semi-Italic").otherwise("-Text"))
    return read(spark, sf, "part").select(k.alias("id"), base.alias("base")).select("id", T.font_parts(F.col("base")).alias("p")).select("id", "p.*")


@query("jn_font_resources", X.twin("ops", "select cast(w as bigint) as font, count(*) as n_used, count(distinct page_id) as n_pages, min(page_id) as first_page from ops where operator='Tf' group by w"))
def font_resources(spark, sf):
    u = X.ops(spark, sf).where("operator = 'Tf'").groupBy(F.col("w").cast("bigint").alias("font"))
    return u.agg(F.count("*").alias("n_used"), F.countDistinct("page_id").alias("n_pages"), F.min("page_id").alias("first_page"))


UNITS = "units as (select page_id, page_id || '-text-' || lpad(cast(row_number() over (partition by page_id order by y, node_no) as varchar), 5, '0') as unit_id, row_number() over (partition by page_id order by y, node_no) as pos, node_id, text from nodes where type in ('text_band','text_fragment','heading','caption') and trim(coalesce(text,''))<>'')"


def units(spark, sf):
    n = X.nodes(spark, sf).where(F.col("type").isin("text_band", "text_fragment", "heading", "caption") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    pos = F.row_number().over(Window.partitionBy("page_id").orderBy("y", "node_no"))
    return n.withColumn("pos", pos).select("page_id", F.format_string("%s-text-%05d", "page_id", "pos").alias("unit_id"), F.col("pos").cast("bigint").alias("pos"), "node_id", "text")


@query("tr_translation_units", X.twin("nodes", f"with {UNITS} select * from units"))
def translation_units(spark, sf):
    return units(spark, sf)


@query("snk_translation_request", X.twin("nodes", f"with {UNITS} select page_id, count(*) as n_units, string_agg(unit_id || '=' || text, chr(10) order by pos) as body from units group by page_id"))
def translation_request(spark, sf):
    u = units(spark, sf)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.concat_ws("=", "unit_id", "text").alias("line")))), lambda s: s["line"]), "\n")
    return u.groupBy("page_id").agg(F.count("*").alias("n_units"), body.alias("body"))


@query("val_translation", X.twin("nodes", f"with {UNITS} select count(*) as n, count(*) - count(distinct unit_id) as n_repeated, count(*) filter (trim(text)='') as n_empty, count(*) filter (not exists (select 1 from renderable_pages p where p.page_id=units.page_id)) as n_lost from units"))
def translation_valid(spark, sf):
    u = units(spark, sf)
    lost = u.join(read(spark, sf, "renderable_pages").select("page_id").distinct(), "page_id", "left_anti").agg(F.count("*").alias("n_lost"))
    own = u.agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("unit_id")).alias("n_repeated"), F.count_if(F.trim("text") == "").alias("n_empty"))
    return own.withColumn("one", F.lit(1)).join(lost.withColumn("one", F.lit(1)), "one").drop("one")


# rendering


@query("snk_page_html", X.twin("nodes", """with d as (select *, case when type in ('image','diagram_component','table') then 0 else 1 end as layer, case when type in ('text_fragment','caption','heading','header','footer','page_number') then replace(replace(replace(coalesce(text,''),'&','&amp;'),'<','&lt;'),'>','&gt;') when type='equation' then replace(replace(replace(coalesce(latex,''),'&','&amp;'),'<','&lt;'),'>','&gt;') when type in ('image','diagram_component','table','rule') then '' end as body from nodes) select page_id, string_agg('<div class="' || type || '" style="' || format('left:{}px;top:{}px;width:{}px;height:{}px', x, y, w, h) || '">' || body || '</div>', chr(10) order by layer, y, x, node_id) as html from d where body is not null group by page_id"""))
def page_html(spark, sf):
    return render.page_html(X.nodes(spark, sf))


@query("fn_latex_html", X.twin("nodes", "select node_id, regexp_replace(replace(latex, ' ', ''), '_([A-Za-z0-9])', '<sub>\\1</sub>', 'g') as html from nodes where latex is not null and regexp_full_match(latex, '[A-Za-z]_[A-Za-z0-9] = [0-9.]+')"))
def latex_html(spark, sf):
    n = X.nodes(spark, sf).where(F.col("latex").rlike(r"^[A-Za-z]_[A-Za-z0-9] = [0-9.]+$"))
    return n.select("node_id", render.latex_html(F.col("latex")).alias("html"))


@query("fn_math_marks", X.twin("nodes", "select node_id, trim(latex) as a, trim(latex) as b, trim(latex) as c from nodes where trim(coalesce(latex,''))<>''"))
def math_marks(spark, sf):
    n = X.nodes(spark, sf).where(T.filled(F.col("latex")).isNotNull())
    wrap = lambda a, b: T.without_math_marks(F.concat(F.lit(a), F.col("latex"), F.lit(b)))
    return n.select("node_id", wrap("$$ ", " $$").alias("a"), wrap(r"\(", r"\)").alias("b"), T.without_math_marks(F.col("latex")).alias("c"))


@query("snk_overlay_order", X.twin("solid", "select a.node_id, count(b.node_id) as depth, cast(row_number() over (partition by a.page_id order by count(b.node_id), -a.w*a.h, a.node_id) as bigint) as pos from solid a left join solid b on a.page_id=b.page_id and a.node_id<>b.node_id and a.x>=b.x and a.y>=b.y and a.x+a.w<=b.x+b.w and a.y+a.h<=b.y+b.h group by a.page_id, a.node_id, a.w, a.h"))
def overlay_order(spark, sf):
    """Boxes by how many others hold them, larger ones first."""
    from leafloom.operators import match

    s = X.solid(spark, sf)
    o = s.select("page_id", F.col("node_id").alias("other"), F.col("b").alias("o"))
    held = match.candidates(s.select("page_id", "node_id", "b"), o, ["page_id"], (F.col("node_id") != F.col("other")) & B.contains(F.col("o"), F.col("b")), "left")
    d = held.groupBy("page_id", "node_id").agg(F.count("other").alias("depth"), F.first("b").alias("b"))
    w = Window.partitionBy("page_id").orderBy("depth", -B.area(F.col("b")), "node_id")
    return d.select("node_id", "depth", F.row_number().over(w).cast("bigint").alias("pos"))


# state saves


@query("app_latest_state", "select user_id, max(event_id) as event_id, arg_max(event_type, (ts, event_id)) as event_type, count(*) as n from events group by user_id")
def latest_state(spark, sf):
    e = read(spark, sf, "events")
    return e.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.count("*").alias("n"))


@query("agg_tumbling_saves", "select event_type, cast(epoch(time_bucket(interval '1 hour', ts)) as bigint) as hour, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling(spark, sf):
    e = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.unix_timestamp("w.start").alias("hour"), "n", "total")


@query("agg_session_saves", "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from g) select user_id, cast(floor(epoch(min(ts))) as bigint) as start, count(*) as n from s group by user_id, k")
def sessions(spark, sf):
    e = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_timestamp("w.start").alias("start"), "n")


@query("pipe_translation_ready", X.twin("nodes", f"with {UNITS} select 'units' as tbl, count(*) as n from units union all select 'unit_problems', 0 union all select 'sections', count(*) from (select distinct n.page_id, (select max(r.y) from nodes r where r.page_id=n.page_id and r.type='rule' and r.w>=20*r.h and r.y<=n.y+n.h/2.0) from nodes n where not (n.type='rule' and n.w>=20*n.h))"))
def pipe_translation_ready(spark, sf):
    """The chain that makes pages ready for translation; rows of its results."""
    from leafloom import transforms

    n = X.nodes(spark, sf)
    ops = X.ops(spark, sf).withColumn("page_id", F.col("page_id").cast("string"))
    out = transforms.run({"nodes": n, "ops": ops}, {"transforms": transforms.CHAINS["translation"]})
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
    return count("units", out["units"]).unionByName(count("unit_problems", out["unit_problems"])).unionByName(count("sections", out["groups"].where("kind = 'section'")))


@query("pipe_operation_groups")
def pipe_operation_groups(spark, sf):
    """Operations to groups with associated text, wrapped, as tables, with growth and tree: rows by kind. Parts have twins of their own."""
    from leafloom import transforms

    out = transforms.run({"ops": X.ops(spark, sf)}, {"transforms": ["geometry.operations-into-groups.v1", "layout.associate-text-operations.v1"]})
    kinds = out["groups"].groupBy(F.col("kind").alias("kind")).agg(F.count("*").alias("n"))
    return kinds.unionByName(out["group_ops"].agg(F.count("*").alias("n")).select(F.lit("claims").alias("kind"), "n"))
