"""Further operators: vector paths, classifications, wrapping, maps, audits."""

from __future__ import annotations

from pyspark.sql import Window
import pandas as pd
from pyspark.sql import functions as F

from leafloom import fixtures as X
from leafloom.functions import box as B
from leafloom.functions import text as T
from leafloom.operators import match
from leafloom.plans import query
from leafloom.session import read

# A path string per part, as an exporter writes rectangles: M x y L x2 y L x2 y2 L x y2 Z
PATHS = "paths as (select p_partkey as id, 'M ' || (20 + p_partkey%300) || ' ' || (p_partkey%500) || ' L ' || (20 + p_partkey%300 + p_size*2) || ' ' || (p_partkey%500) || ' L ' || (20 + p_partkey%300 + p_size*2) || ' ' || (p_partkey%500 + p_partkey%4) || ' L ' || (20 + p_partkey%300) || ' ' || (p_partkey%500 + p_partkey%4) || ' Z' as d from part)"


def paths(spark, sf):
    p = read(spark, sf, "part")
    e = lambda s: F.expr(f"cast({s} as string)")
    x, y, x2, y2 = e("20 + p_partkey % 300"), e("p_partkey % 500"), e("20 + p_partkey % 300 + p_size * 2"), e("p_partkey % 500 + p_partkey % 4")
    return p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", F.lit("M"), x, y, F.lit("L"), x2, y, F.lit("L"), x2, y2, F.lit("L"), x, y2, F.lit("Z")).alias("d"))


def numbers(d):
    return F.transform(F.regexp_extract_all(d, F.lit(r"(-?\d+(?:\.\d+)?)"), 1), lambda v: v.cast("double"))


def path_boxes(df):
    """(id, x, y, w, h, n_points) of vector paths by the numbers in them."""
    n = df.withColumn("n", numbers(F.col("d")))
    xs, ys = F.filter("n", lambda _, i: i % 2 == 0), F.filter("n", lambda _, i: i % 2 == 1)
    points = F.size(F.array_distinct(F.arrays_zip(xs, ys)))
    return n.select("id", F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"), points.cast("bigint").alias("n_points"))


POINTS = f"{PATHS}, nums as (select id, list_transform(regexp_extract_all(d, '-?[0-9]+(\\.[0-9]+)?'), lambda v: cast(v as double)) as n from paths), pts as (select distinct id, n[cast(2*i-1 as int)] as px, n[cast(2*i as int)] as py from nums, unnest(generate_series(1, len(n)//2)) u(i)), boxes as (select id, min(px) as x, min(py) as y, max(px)-min(px) as w, max(py)-min(py) as h, count(*) as n_points from pts group by id)"


@query("fn_path_bbox", f"with {POINTS} select * from boxes")
def path_bbox(spark, sf):
    return path_boxes(paths(spark, sf))


@query("src_vector_rules", f"with {POINTS} select distinct x, y, w, h from boxes where n_points=4 and w>5 and h<=2.5 and least(x, y)>=20")
def vector_rules(spark, sf):
    """Thin four-cornered paths, once each."""
    return path_boxes(paths(spark, sf)).where("n_points = 4 and w > 5 and h <= 2.5 and least(x, y) >= 20").select("x", "y", "w", "h").distinct()


@query("snk_audit_paths", f"with {POINTS} select case when n_points=4 then 'rectangle' when n_points=2 then 'line' else 'other' end as tag, count(*) as n, min(x) as x, max(x+w) as x2 from boxes group by 1")
def audit_paths(spark, sf):
    tag = F.when(F.col("n_points") == 4, "rectangle").when(F.col("n_points") == 2, "line").otherwise("other")
    return path_boxes(paths(spark, sf)).groupBy(tag.alias("tag")).agg(F.count("*").alias("n"), F.min("x").alias("x"), F.max(F.col("x") + F.col("w")).alias("x2"))


@query("src_classify_text", X.twin("solid page_sizes", "select node_id, case when y>height-90 then case when h>=17 then 'page_number' else 'footer' end when class='heading' and (h>=20 or y<220) then 'heading' when y<220 then 'header' else 'body' end as role from solid s join page_sizes p using (page_id) where type in ('text_band','text_fragment')"))
def classify_text(spark, sf):
    j = X.solid(spark, sf).where("type in ('text_band', 'text_fragment')").join(X.page_sizes(spark, sf), "page_id")
    role = F.when(F.col("y") > F.col("height") - 90, F.when(F.col("h") >= 17, "page_number").otherwise("footer")).when((F.col("class") == "heading") & ((F.col("h") >= 20) | (F.col("y") < 220)), "heading").when(F.col("y") < 220, "header").otherwise("body")
    return j.select("node_id", role.alias("role"))


@query("flt_equation_items", X.twin("nodes", "select coalesce(nullif(trim(node_id), ''), 'equation-' || lpad(cast(row_number() over (partition by page_id order by node_no) as varchar), 4, '0')) as item_id, page_id, latex from nodes where type='equation'"))
def equation_items(spark, sf):
    turn = F.row_number().over(Window.partitionBy("page_id").orderBy("node_no"))
    return X.nodes(spark, sf).where("type = 'equation'").withColumn("turn", turn).select(F.coalesce(T.filled(F.col("node_id")), F.format_string("equation-%04d", "turn")).alias("item_id"), "page_id", "latex")


@query("flt_string_leaves", X.twin("items", "select item_no, 'source_text' as path, source_text as leaf from items where source_text is not null union all select item_no, 'ocr_text', ocr_text from items where ocr_text is not null union all select item_no, 'vision_text', vision_text from items where vision_text is not null union all select distinct item_no, 'mask_refs[' || (i-1) || ']', mask_refs[i] from review_items, unnest(generate_series(1, len(mask_refs))) u(i) where item_no is not null and mask_refs[i] is not null"))
def string_leaves(spark, sf):
    """Every text of a record with its path."""
    i = X.items(spark, sf)
    flat = i.select("item_no", F.explode(F.array(*[F.struct(F.lit(c).alias("path"), F.col(c).alias("leaf")) for c in ("source_text", "ocr_text", "vision_text")])).alias("l")).select("item_no", "l.*")
    deep = read(spark, sf, "review_items").where("item_no is not null").select("item_no", F.posexplode("mask_refs").alias("k", "leaf")).select("item_no", F.format_string("mask_refs[%d]", "k").alias("path"), "leaf").distinct()
    return flat.unionByName(deep).where("leaf is not null")


@query("flt_publishable", "select distinct sample_no, problem from (select sample_no, unnest(list_filter([case when regexp_matches(lower(image_path), '\\.(tif|tiff|psd)$') then 'blocked_suffix' end, case when regexp_matches(image_path, '(^|[/\\\\])private([/\\\\]|$)') then 'private_path' end, case when contains(image_path, '\\') then 'backslash' end, case when starts_with(image_path, './') then 'relative_prefix' end], lambda x: x is not null)) as problem from samples where image_path is not null)")
def publishable(spark, sf):
    p = F.col("image_path")
    rules = F.array_compact(F.array(F.when(F.lower(p).rlike(r"\.(tif|tiff|psd)$"), F.lit("blocked_suffix")), F.when(p.rlike(r"(^|[/\\])private([/\\]|$)"), F.lit("private_path")), F.when(p.contains("\\"), F.lit("backslash")), F.when(p.startswith("./"), F.lit("relative_prefix"))))
    return read(spark, sf, "samples").where("image_path is not null").select("sample_no", F.explode(rules).alias("problem")).distinct()


@query("jn_merge_translations", X.twin("items nodes", "with tr as (select target_node as node_id, arg_max(vision_text, item_no) as text from items where target_node is not null and vision_text is not null group by target_node) select n.node_id, coalesce(tr.text, n.text) as text, round(case when tr.text is not null then 0.84 else 1.0 end * n.h, 4) as font_size from nodes n left join tr on tr.node_id=n.node_id"))
def merge_translations(spark, sf):
    tr = X.items(spark, sf).where("target_node is not null and vision_text is not null").groupBy(F.col("target_node").alias("node_id")).agg(F.max_by("vision_text", "item_no").alias("new"))
    j = X.nodes(spark, sf).join(tr, "node_id", "left")
    return j.select("node_id", F.coalesce("new", "text").alias("text"), F.round(F.when(F.col("new").isNotNull(), 0.84).otherwise(1.0) * F.col("h"), 4).alias("font_size"))


@query("jn_nearest_box", X.twin("solid", "with t as (select page_id, node_id, y, x, w from solid where type='heading'), c as (select t.node_id, b.node_id as below, b.y-t.y as dy, row_number() over (partition by t.node_id order by b.y-t.y, b.node_id) as turn from t join solid b on b.page_id=t.page_id and b.type in ('text_band','text_fragment') and b.y>t.y and b.x < t.x+t.w and t.x < b.x+b.w) select node_id, below, dy from c where turn=1"))
def nearest_below(spark, sf):
    """The nearest text below each heading that shares its columns."""
    s = X.solid(spark, sf)
    below = s.where("type in ('text_band', 'text_fragment')").select("page_id", F.col("node_id").alias("below"), F.col("b").alias("o"))
    hit = match.candidates(s.where("type = 'heading'").select("page_id", "node_id", "b"), below, ["page_id"], (F.col("o.y") > F.col("b.y")) & (B.overlap_x(F.col("b"), F.col("o")) > 0)).withColumn("dy", F.col("o.y") - F.col("b.y"))
    return match.best(hit, ["node_id"], "dy", "below").select("node_id", "below", "dy")


@query("tr_wrap_text", X.twin("solid", """with recursive w as (select n.node_id, n.w as box, n.h, greatest(n.h, 1) as size, string_split_regex(regexp_replace(n.text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), '[\\s\\p{Z}]+') as ws from solid n where type in ('text_band','text_fragment') and trim(coalesce(text,''))<>''), l(node_id, box, h, size, ws, i, n_lines, len) as (select node_id, box, h, size, ws, 1, 1, length(ws[1]) from w union all select node_id, box, h, size, ws, i+1, case when (len + 1 + length(ws[i+1])) * 0.125 * size <= box then n_lines else n_lines+1 end, case when (len + 1 + length(ws[i+1])) * 0.125 * size <= box then len + 1 + length(ws[i+1]) else length(ws[i+1]) end from l where i < len(ws)) select node_id, cast(max(n_lines) as bigint) as n_lines from l where i = len(ws) group by node_id""").replace("with nodes as", "with recursive nodes as", 1).replace(", recursive w", ", w"))
def wrap_text(spark, sf):
    """Lines that a text needs in its own box, word by word."""
    from leafloom.operators import wrap

    n = X.solid(spark, sf).where("type in ('text_band', 'text_fragment') and trim(coalesce(text, '')) <> ''")
    count = F.pandas_udf(lambda t, s, w: pd.Series([len(wrap.lines(x, y, z, 0.125)) for x, y, z in zip(t, s, w)]), "bigint")
    return n.groupBy("node_id").agg(F.max(count(F.col("text"), F.greatest(F.col("h"), F.lit(1)).cast("double"), F.col("w").cast("double"))).alias("n_lines"))


@query("tr_wrap_obstacles")
def wrap_obstacles(spark, sf):
    """Texts wrapped before what stands in their way, with what they push down; each page's texts depend on each other, so there is no SQL twin."""
    from leafloom.operators import wrap

    s = X.solid(spark, sf)
    texts = s.where("type in ('text_band', 'text_fragment')").select("page_id", "node_id", "node_no", "x", "y", "w", "h", F.lit(14.0).alias("size"), "text")
    return wrap.around_obstacles(texts, X.obstacles(spark, sf))


@query("fn_split_evenly", X.twin("solid", "select node_id, cast(i as bigint) as part, y + cast(round_even(h*(i-1)/3.0, 0) as bigint) as lo, y + cast(round_even(h*i/3.0, 0) as bigint) as hi from solid, unnest(generate_series(1, 3)) u(i) where type='table'"))
def split_evenly(spark, sf):
    s = X.solid(spark, sf).where("type = 'table'").select("node_id", "y", "h", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i"))
    cut = lambda k: (F.col("y") + F.bround(F.col("h") * k / 3.0).cast("bigint"))
    return s.select("node_id", F.col("i").cast("bigint").alias("part"), cut(F.col("i") - 1).alias("lo"), cut(F.col("i")).alias("hi"))


CMAP = "maps as (select n_nationkey as id, '<' || lpad(to_hex(n_nationkey), 4, '0') || '> <' || lpad(to_hex(n_nationkey+10), 4, '0') || '> <' || lpad(to_hex(n_nationkey + 65), 4, '0') || '>' as line from nation)"


@query("fn_cmap_ranges", f"with {CMAP} select n_nationkey as id, n_nationkey + i as code, chr(cast(n_nationkey + 65 + i as int)) as ch from nation, unnest(generate_series(0, 10)) u(i)")
def cmap_ranges(spark, sf):
    """Ranges of a character map opened into single codes."""
    h = lambda e: F.lpad(F.hex(F.expr(e)), 4, "0")
    lines = read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.format_string("<%s> <%s> <%s>", h("n_nationkey"), h("n_nationkey + 10"), h("n_nationkey + 65")).alias("line"))
    part = F.regexp_extract_all("line", F.lit("<([0-9A-Fa-f]+)>"), 1)
    n = lambda k: F.conv(F.get(part, F.lit(k)), 16, 10).cast("bigint")
    each = lines.select("id", n(0).alias("lo"), n(1).alias("hi"), n(2).alias("to")).withColumn("code", F.explode(F.sequence("lo", "hi")))
    return each.select("id", "code", F.char(F.col("to") + F.col("code") - F.col("lo")).alias("ch"))


@query("agg_font_entries", "select b.book_id, len(fonts) as n_fonts, case when author_name is null then 'missing-author' end as a, array_to_string(list_sort(list_filter([case when len(fonts)=0 then 'no-font' end, case when page_count is null then 'missing-page-count' end, case when book_lang is null then 'missing-language' end], lambda x: x is not null)), ',') as issues from books b")
def font_entries(spark, sf):
    b = read(spark, sf, "books")
    issues = F.array_sort(F.array_compact(F.array(F.when(F.size("fonts") == 0, F.lit("no-font")), F.when(F.col("page_count").isNull(), F.lit("missing-page-count")), F.when(F.col("book_lang").isNull(), F.lit("missing-language")))))
    return b.select("book_id", F.size("fonts").alias("n_fonts"), F.when(F.col("author_name").isNull(), F.lit("missing-author")).alias("a"), F.array_join(issues, ",").alias("issues"))


@query("top_next_reference", "select max(cast(split_part(ref, ' ', 1) as bigint)) + 1 as next_ref from (select (s_suppkey + 7) || ' 0' as ref from supplier)")
def next_reference(spark, sf):
    ref = F.concat((F.col("s_suppkey") + 7).cast("string"), F.lit(" 0"))
    return read(spark, sf, "supplier").select(ref.alias("ref")).agg((F.max(F.regexp_extract("ref", r"^(\d+) 0$", 1).cast("bigint")) + 1).alias("next_ref"))


@query("snk_overlay_text", X.twin("nodes", "select node_id, round(x/1.5, 6) as px, round(841.92-(y+h)/1.5+0.12*(h*0.885), 6) as py, case when class='heading' then 'serif-bold' when latex is not null then 'math' else 'serif' end as face from nodes where text is not null or latex is not null"))
def overlay_text(spark, sf):
    n = X.nodes(spark, sf).where("text is not null or latex is not null")
    face = F.when(F.col("class") == "heading", "serif-bold").when(F.col("latex").isNotNull(), "math").otherwise("serif")
    return n.select("node_id", F.round(F.col("x") / 1.5, 6).alias("px"), F.round(841.92 - (F.col("y") + F.col("h")) / 1.5 + 0.12 * (F.col("h") * 0.885), 6).alias("py"), face.alias("face"))


@query("snk_origin_chain", X.twin("groups", "with recursive t(group_id, ax, ay, d) as (select group_id, x, y, 0 from groups where parent_id is null union all select g.group_id, t.ax+g.x, t.ay+g.y, t.d+1 from groups g join t on g.parent_id=t.group_id) select group_id, ax, ay from t").replace("with groups as", "with recursive groups as").replace(", recursive t", ", t"))
def origin_chain(spark, sf):
    """Absolute places from origins relative to the parent: sums along each path."""
    from leafloom.operators import tree as R

    g = X.groups(spark, sf)
    a = R.ancestors(R.paths(g, "group_id", "parent_id"), "group_id")
    own = g.select(F.col("group_id").alias("ancestor"), "x", "y")
    return a.join(own, "ancestor").groupBy("group_id").agg(F.sum("x").alias("ax"), F.sum("y").alias("ay"))


@query("set_tag_union", "select sample_id, array_to_string(list_sort(list_distinct(flatten(list(coalesce(tags, []))))), ',') as tags from samples where sample_id is not null group by sample_id")
def tag_union(spark, sf):
    t = F.coalesce("tags", F.array().cast("array<string>"))
    return read(spark, sf, "samples").where("sample_id is not null").groupBy("sample_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(t)))), ",").alias("tags"))


@query("val_source_page", "select page_id, count(*) filter (node_id is null) as n_without_id, count(*) - count(distinct node_no) as n_repeated, count(*) filter (bbox is null) as n_without_box from page_nodes group by page_id")
def source_page(spark, sf):
    return read(spark, sf, "page_nodes").groupBy("page_id").agg(F.count_if(F.col("node_id").isNull()).alias("n_without_id"), (F.count("*") - F.countDistinct("node_no")).alias("n_repeated"), F.count_if(F.col("bbox").isNull()).alias("n_without_box"))


@query("agg_crop_seed", X.twin("crops", "select book, coalesce(median(case when has_crop=1 then w end), 2200) as w, coalesce(median(case when has_crop=1 then h end), 3400) as h, coalesce(median(case when has_crop=1 then case when page%2=0 then x else img_w-x-w end end), 8) as inner_margin, count(*) filter (has_crop=0) as n_open from crops group by book"))
def crop_seed(spark, sf):
    m = lambda e, d: F.coalesce(F.percentile(F.expr(f"case when has_crop = 1 then {e} end"), 0.5), F.lit(float(d)))
    return X.crops(spark, sf).groupBy("book").agg(m("w", 2200).alias("w"), m("h", 3400).alias("h"), m("case when page % 2 = 0 then x else img_w - x - w end", 8).alias("inner_margin"), F.count_if(F.col("has_crop") == 0).alias("n_open"))


@query("fn_extract_json", X.twin("items", "select item_no, case when item_no%3=0 then null else '{\"n\": ' || item_no || ', \"of\": {\"x\": 1}}' end as object from items"))
def extract_json(spark, sf):
    """Objects out of replies: fenced, amid words, or cut off."""
    k = F.col("item_no")
    body = F.concat(F.lit('{"n": '), k.cast("string"), F.lit(', "of": {"x": 1}}'))
    reply = F.when(k % 3 == 0, F.concat(F.lit("Here: "), F.substring(body, 1, 5), F.lit("}"))).when(k % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("It is "), body, F.lit(", I think.")))
    return X.items(spark, sf).select("item_no", T.json_object(reply).alias("object"))


@query("fn_extract_text", X.twin("items", "select item_no, trim(case when item_no%2=0 then 'whole ' || item_no else 'a' || item_no || 'b' end) as text from items"))
def extract_text(spark, sf):
    """The text of model responses, given whole or in parts."""
    k = F.col("item_no").cast("string")
    parts = F.concat(F.lit('{"output": [{"content": [{"text": "a'), k, F.lit('"}, {"text": " "}, 3]}, 7, {"content": [{"output_text": "b"}]}, {"content": "x"}]}'))
    whole = F.concat(F.lit('{"output_text": " whole '), k, F.lit(' ", "output": []}'))
    return X.items(spark, sf).select("item_no", T.payload_text(F.when(F.col("item_no") % 2 == 0, whole).otherwise(parts)).alias("text"))


MASKS = "m as (select vec_id as page_id, list_transform(embedding, lambda v: case when v > 0.15 then 255 else 0 end) as t, list_transform(embedding, lambda v: case when v < 0 then 255 else 0 end) as e from embeddings)"


@query("set_mask_union", f"with {MASKS}, u as (select *, list_max(t) = 0 and list_max(e) > 0 as whole from m) select page_id, whole as promoted_to_page, cast(case when whole then len(t) else len(list_filter(range(1, len(t)+1), lambda i: t[i] = 0 and e[i] > 0)) end as bigint) as n_promoted, cast(case when whole then 255 * len(t) else list_sum(list_transform(range(1, len(t)+1), lambda i: greatest(t[i], e[i]))) end as bigint) as ink from u")
def mask_union(spark, sf):
    """Text masks with the formulas' pixels; an empty one beside formulas becomes the whole page."""
    from leafloom.operators import image as I

    level = lambda f: F.unhex(F.array_join(F.transform("embedding", lambda v: F.when(f(v), "FF").otherwise("00")), ""))
    m = read(spark, sf, "embeddings").select(F.col("vec_id").alias("page_id"), level(lambda v: v > 0.15).alias("text_mask"), level(lambda v: v < 0).alias("formula_mask"))
    out = I.mask_union(m, "text_mask", "formula_mask")
    return out.select("page_id", "promoted_to_page", "n_promoted", F.aggregate(F.transform(F.sequence(F.lit(1), F.length("mask")), lambda i: F.ascii(F.decode(F.substring("mask", i, F.lit(1)), "ISO-8859-1"))), F.lit(0), lambda a, x: a + x).cast("bigint").alias("ink"))


@query("src_zero_assets", "select vec_id as page_id, len(list_filter(embedding[1:12], lambda v: v > 0.1)) = 0 as is_zero from embeddings")
def zero_assets(spark, sf):
    """Images without any visible sample: all colours are zero, whatever the alpha."""
    from leafloom.operators import image as I

    pixels = F.transform(F.slice("embedding", 1, 12), lambda v: F.when(v > 0.1, "1F").otherwise("00"))
    rgba = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.concat(F.get(pixels, 3 * k), F.get(pixels, 3 * k + 1), F.get(pixels, 3 * k + 2), F.lit("FF"))), "")
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("page_id"), I.is_zero(F.unhex(rgba), 4).alias("is_zero"))
