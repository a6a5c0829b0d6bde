"""Trees, crops, review and OCR records, text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafloom import fixtures as X
from leafloom.functions import text as T
from leafloom.operators import sequence as S
from leafloom.operators import tree as R
from leafloom.plans import query
from leafloom.session import materialize, read

TREE = "tree as (with recursive t(group_id, parent_id, child_idx, x, y, w, h, path, depth) as (select group_id, parent_id, child_idx, x, y, w, h, [group_id], 0 from groups where parent_id is null union all select g.group_id, g.parent_id, g.child_idx, g.x, g.y, g.w, g.h, list_append(t.path, g.group_id), t.depth+1 from groups g join t on g.parent_id=t.group_id) select * from t)"


def pathed(spark, sf):
    return R.paths(X.groups(spark, sf), "group_id", "parent_id")


@query("jn_ancestor_paths", X.twin("groups", f"with {TREE} select group_id, array_to_string(path, '/') as path, cast(depth as bigint) as depth from tree"))
def ancestor_paths(spark, sf):
    return pathed(spark, sf).select("group_id", F.array_join("path", "/").alias("path"), F.col("depth").cast("bigint").alias("depth"))


@query("src_reachable_objects", X.twin("groups", f"with {TREE}, u as (select group_id, depth, unnest(path) as ancestor, generate_subscripts(path, 1) as place from tree) select ancestor, count(*) as n_reached, cast(max(depth + 1 - place) as bigint) as farthest from u group by ancestor"))
def reachable_objects(spark, sf):
    a = R.ancestors(pathed(spark, sf), "group_id")
    return a.groupBy("ancestor").agg(F.count("*").alias("n_reached"), F.max("distance").cast("bigint").alias("farthest"))


@query("tr_growth", X.twin("groups", f"with {TREE}, u as (select unnest(path) as root, x, y, w, h from tree) select root as group_id, min(x) as x, min(y) as y, max(x+w)-min(x) as w, max(y+h)-min(y) as h, count(*) as n from u group by root"))
def growth(spark, sf):
    """Containers grown to hold their whole subtree."""
    x2, y2 = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return R.subtree(pathed(spark, sf), "group_id", [], F.min("x").alias("x"), F.min("y").alias("y"), (x2 - F.min("x")).alias("w"), (y2 - F.min("y")).alias("h"), F.count("*").alias("n"))


@query("isl_sibling_offsets", X.twin("groups", "select group_id, x - coalesce(lag(x) over w, 0) as dx, y - coalesce(lag(y) over w, 0) as dy from groups window w as (partition by parent_id order by child_idx)"))
def sibling_offsets(spark, sf):
    return R.siblings(X.groups(spark, sf), [], "parent_id", "child_idx", F.col("x").isNotNull(), "x", "y").select("group_id", "dx", "dy")


@query("tr_relative", X.twin("groups", f"with {TREE} select t.group_id, t.x - coalesce(p.x, 0) as rx, t.y - coalesce(p.y, 0) as ry, cast(t.depth as bigint) as depth from tree t left join groups p on p.group_id=t.parent_id"))
def relative(spark, sf):
    g = X.groups(spark, sf)
    p = g.select(F.col("group_id").alias("parent_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    return pathed(spark, sf).join(p, "parent_id", "left").select("group_id", (F.col("x") - F.coalesce("px", F.lit(0))).alias("rx"), (F.col("y") - F.coalesce("py", F.lit(0))).alias("ry"), F.col("depth").cast("bigint").alias("depth"))


@query("tr_one_cell_table", X.twin("groups", "with leaf as (select * from groups g where not exists (select 1 from groups c where c.parent_id=g.group_id)) select group_id, parent_id, 'table' as kind, x, y, w, h from leaf union all select group_id || '::cell', group_id, 'cell', x, y, w, h from leaf"))
def one_cell_table(spark, sf):
    g = X.groups(spark, sf)
    leaf = g.join(g.select(F.col("parent_id").alias("group_id")).distinct(), "group_id", "left_anti")
    kinds = F.explode(F.array(F.struct(F.col("group_id").alias("id"), F.col("parent_id").alias("up"), F.lit("table").alias("kind")), F.struct(F.concat("group_id", F.lit("::cell")).alias("id"), F.col("group_id").alias("up"), F.lit("cell").alias("kind"))))
    return leaf.withColumn("k", kinds).select(F.col("k.id").alias("group_id"), F.col("k.up").alias("parent_id"), "k.kind", "x", "y", "w", "h")


@query("tr_expand_content", X.twin("groups", f"with {TREE}, u as (select path[1] as root, x, y, w, h from tree) select root || '-wrapper' as group_id, root as inner_id, min(x) as x, min(y) as y, max(x+w)-min(x) as w, max(y+h)-min(y) as h from u group by root"))
def expand_content(spark, sf):
    """A wrapper round each root that holds the text below it."""
    p = pathed(spark, sf).groupBy(F.get("path", F.lit(0)).alias("inner_id")).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"))
    return p.select(F.concat("inner_id", F.lit("-wrapper")).alias("group_id"), "inner_id", "x", "y", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"))


@query("tr_debug_depth", X.twin("groups", f"with {TREE} select group_id, round(greatest(0.75, 0.96 - 0.06*depth), 4) as fill_gray from tree"))
def debug_depth(spark, sf):
    return pathed(spark, sf).select("group_id", F.round(F.greatest(F.lit(0.75), 0.96 - 0.06 * F.col("depth")), 4).alias("fill_gray"))


@query("tr_identity", X.twin("nodes", "select 'lost' as side, count(*) as n from (select node_id from nodes except select node_id from nodes) union all select 'all', count(*) from nodes"))
def identity(spark, sf):
    n = X.nodes(spark, sf).drop("b")
    same = n.select("*")
    lost = n.exceptAll(same).unionByName(same.exceptAll(n)).agg(F.count("*").alias("n")).select(F.lit("lost").alias("side"), "n")
    return lost.unionByName(same.agg(F.count("*").alias("n")).select(F.lit("all").alias("side"), "n"))


# crops


@query("agg_frame_model_medians", X.twin("crops", "select book, median(y) as top, median(img_h-y-h) as bottom, median(w) as w, median(h) as h, median(case when page%2=0 then x else img_w-x-w end) as outer_edge, median(img_w) as source_w, median(img_h) as source_h from crops where has_crop=1 group by book"))
def frame_model(spark, sf):
    c = X.crops(spark, sf).where("has_crop = 1")
    m = lambda e: F.percentile(F.expr(e), 0.5)
    return c.groupBy("book").agg(m("y").alias("top"), m("img_h - y - h").alias("bottom"), m("w").alias("w"), m("h").alias("h"), m("case when page % 2 = 0 then x else img_w - x - w end").alias("outer_edge"), m("img_w").alias("source_w"), m("img_h").alias("source_h"))


@query("agg_percentile", X.twin("crops", "select book, quantile_cont(w, 0.1) as p10, quantile_cont(w, 0.92) as p92 from crops group by book"))
def percentiles(spark, sf):
    return X.crops(spark, sf).groupBy("book").agg(F.percentile("w", 0.1).alias("p10"), F.percentile("w", 0.92).alias("p92"))


@query("agg_weighted_median", X.twin("crops", "with t as (select book, x, sum(h) as w from crops group by book, x), r as (select *, sum(w) over (partition by book order by x) as c, sum(w) over (partition by book) as t from t) select book, min(x) as x from r where c >= t/2.0 group by book"))
def weighted_median(spark, sf):
    return S.weighted_median(X.crops(spark, sf), ["book"], "x", "h")


@query("fn_page_side_crop", X.twin("crops", "with m as (select book, median(w) as mw, median(h) as mh, median(x) as mx, median(y) as my, median(img_w) as sw from crops where has_crop=1 group by book) select c.page, case when (c.page+1)%2=1 then 'right' else 'left' end as side, case when has_crop=1 then 'saved' else 'model' end as how, case when has_crop=1 then x else round_even(case when (c.page+1)%2=1 then mx else sw-mx-mw end * img_w / sw, 0) end as cx, case when has_crop=1 then w else round_even(mw*img_w/sw, 0) end as cw from crops c join m on m.book=c.book"))
def page_side_crop(spark, sf):
    """The saved crop of a page, else the model's for its side, scaled to the page's image."""
    c = X.crops(spark, sf)
    md = lambda x: F.percentile(x, 0.5)
    m = c.where("has_crop = 1").groupBy("book").agg(md("w").alias("mw"), md("x").alias("mx"), md("img_w").alias("sw"))
    right = (F.col("page") + 1) % 2 == 1
    j = c.join(m, "book")
    x = F.bround(F.when(right, F.col("mx")).otherwise(F.col("sw") - F.col("mx") - F.col("mw")) * F.col("img_w") / F.col("sw"))
    own = F.col("has_crop") == 1
    return j.select("page", F.when(right, "right").otherwise("left").alias("side"), F.when(own, "saved").otherwise("model").alias("how"), F.when(own, F.col("x")).otherwise(x).alias("cx"), F.when(own, F.col("w")).otherwise(F.bround(F.col("mw") * F.col("img_w") / F.col("sw"))).alias("cw"))


@query("fn_margins", X.twin("crops", "select page, case when page%2=0 then x else img_w-x-w end as inner_margin, case when page%2=0 then img_w-x-w else x end as outer_margin, least(greatest(y,0), img_h) as top, greatest(img_h-y-h, 0) as bottom from crops"))
def margins(spark, sf):
    even = F.col("page") % 2 == 0
    left, right = F.col("x"), F.col("img_w") - F.col("x") - F.col("w")
    return X.crops(spark, sf).select("page", F.when(even, left).otherwise(right).alias("inner_margin"), F.when(even, right).otherwise(left).alias("outer_margin"), F.least(F.greatest("y", F.lit(0)), "img_h").alias("top"), F.greatest(F.col("img_h") - F.col("y") - F.col("h"), F.lit(0)).alias("bottom"))


@query("top_straightest", X.twin("crops", "select book, page, cast(turn as bigint) as turn from (select book, page, row_number() over (partition by book order by abs(angle), page) as turn from crops) where turn<=4"))
def straightest(spark, sf):
    w = Window.partitionBy("book").orderBy(F.abs("angle"), "page")
    return X.crops(spark, sf).withColumn("turn", F.row_number().over(w).cast("bigint")).where("turn <= 4").select("book", "page", "turn")


# review


ITEM_TEXT = "coalesce(nullif(trim(c.correction),''), nullif(trim(vision_text_with_refs),''), nullif(trim(vision_text),''), nullif(trim(ocr_text),''), nullif(trim(source_text),''))"


@query("src_corrections", "select item_id, max(file_name) as file_name, arg_max(correction, file_name) as correction, count(distinct file_name) as n_files from corrections where item_id is not null and file_name is not null group by item_id")
def corrections(spark, sf):
    c = read(spark, sf, "corrections").where("item_id is not null and file_name is not null")
    return c.groupBy("item_id").agg(F.max("file_name").alias("file_name"), F.max_by("correction", "file_name").alias("correction"), F.countDistinct("file_name").alias("n_files"))


@query("jn_merge_precedence", X.twin("items", f"with c as (select item_id, arg_max(correction, file_name) as correction from corrections where item_id is not null group by item_id) select i.item_no, {ITEM_TEXT} as text, case when nullif(trim(c.correction),'') is not null then 'correction' when nullif(trim(vision_text_with_refs),'') is not null then 'refs' when nullif(trim(vision_text),'') is not null then 'vision' when nullif(trim(ocr_text),'') is not null then 'ocr' when nullif(trim(source_text),'') is not null then 'source' end as provenance from items i left join c on c.item_id=i.item_id"))
def merge_precedence(spark, sf):
    c = read(spark, sf, "corrections").where("item_id is not null").groupBy("item_id").agg(F.max_by("correction", "file_name").alias("correction"))
    order = (("correction", "correction"), ("vision_text_with_refs", "refs"), ("vision_text", "vision"), ("ocr_text", "ocr"), ("source_text", "source"))
    j = X.items(spark, sf).join(c, "item_id", "left")
    where = F.coalesce(*[F.when(T.filled(F.col(k)).isNotNull(), F.lit(name)) for k, name in order])
    return j.select("item_no", T.first_filled(*[F.col(k) for k, _ in order]).alias("text"), where.alias("provenance"))


@query("jn_merge_into_nodes", X.twin("items nodes", f"with c as (select item_id, arg_max(correction, file_name) as correction from corrections where item_id is not null group by item_id), m as (select i.item_no, target_node, {ITEM_TEXT} as text from items i left join c on c.item_id=i.item_id where target_node is not null), l as (select target_node, arg_max(text, item_no) as text, count(*) as n_items from m where text is not null group by target_node) select n.node_id, l.text, l.n_items from nodes n join l on l.target_node=n.node_id"))
def merge_into_nodes(spark, sf):
    """The last item wins where several hit one node."""
    m = merge_precedence(spark, sf).join(X.items(spark, sf).select("item_no", F.col("target_node").alias("node_id")), "item_no").where("node_id is not null and text is not null")
    last = m.groupBy("node_id").agg(F.max_by("text", "item_no").alias("text"), F.count("*").alias("n_items"))
    return X.nodes(spark, sf).select("node_id").join(last, "node_id")


@query("agg_review_summary", X.twin("items", "select coalesce(review_action,'all') as review_action, coalesce(ocr_engine,'all') as ocr_engine, count(*) as n, count(*) filter (vision_text is null) as n_open from (select coalesce(review_action,'none') as review_action, coalesce(ocr_engine,'none') as ocr_engine, vision_text from items) group by grouping sets ((review_action, ocr_engine), (review_action), ())"))
def review_summary(spark, sf):
    i = X.items(spark, sf).select(F.coalesce("review_action", F.lit("none")).alias("review_action"), F.coalesce("ocr_engine", F.lit("none")).alias("ocr_engine"), "vision_text")
    g = i.groupingSets([["review_action", "ocr_engine"], ["review_action"], []], "review_action", "ocr_engine").agg(F.count("*").alias("n"), F.count_if(F.col("vision_text").isNull()).alias("n_open"))
    return g.select(F.coalesce("review_action", F.lit("all")).alias("review_action"), F.coalesce("ocr_engine", F.lit("all")).alias("ocr_engine"), "n", "n_open")


@query("app_resume_open_items", X.twin("items", "select item_no from items where not exists (select 1 from corrections c where c.item_id=items.item_id)"))
def open_items(spark, sf):
    return X.items(spark, sf).join(read(spark, sf, "corrections").select("item_id").distinct(), "item_id", "left_anti").select("item_no")


# OCR


@query("agg_cer_by_group", X.twin("ascii", "with g as (select distinct sample_no, unnest(list_concat(['split:' || coalesce(split,'none')], list_transform(coalesce(tags, []), lambda t: 'tag:' || t))) as grp, gt, ocr_a, ocr_b from ascii) select grp, count(*) as n, cast(sum(greatest(1,length(gt))) as bigint) as chars, cast(sum(levenshtein(gt, ocr_a)) as bigint) as edits_a, cast(sum(levenshtein(gt, ocr_b)) as bigint) as edits_b, round(sum(levenshtein(gt, ocr_a))*1.0/sum(greatest(1,length(gt))), 6) as cer_a from g group by grp"))
def cer_by_group(spark, sf):
    s = X.ascii_samples(spark, sf)
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("tag:"), t))
    both = F.array_union(F.array(F.concat(F.lit("split:"), F.coalesce("split", F.lit("none")))), tags)
    each = s.withColumn("chars", F.greatest(F.lit(1), F.length("gt"))).withColumn("a", F.levenshtein("gt", "ocr_a")).withColumn("b", F.levenshtein("gt", "ocr_b")).withColumn("grp", F.explode(both))
    return each.groupBy("grp").agg(F.count("*").alias("n"), F.sum("chars").cast("bigint").alias("chars"), F.sum("a").cast("bigint").alias("edits_a"), F.sum("b").cast("bigint").alias("edits_b"), F.round(F.sum("a") / F.sum("chars"), 6).alias("cer_a"))


@query("fn_levenshtein_ascii", X.twin("ascii", "select sample_no, cast(levenshtein(gt, ocr_a) as bigint) as d from ascii"))
def levenshtein_ascii(spark, sf):
    return X.ascii_samples(spark, sf).select("sample_no", F.levenshtein("gt", "ocr_a").cast("bigint").alias("d"))


@query("agg_sample_merge", "select sample_id, count(*) as n_rows, count(distinct text_lines) as n_texts, bool_or(lower(trim(split_name))='eval') as any_eval, array_to_string(list_sort(list_distinct(flatten(list(coalesce(tags, []))))), ',') as tags, arg_min(psm, sample_no) as psm from samples where sample_id is not null group by sample_id")
def sample_merge(spark, sf):
    s = read(spark, sf, "samples").where("sample_id is not null")
    tags = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tags", F.array().cast("array<string>")))))), ",")
    first_psm = F.min_by("psm", F.when(F.col("psm").isNotNull(), F.col("sample_no")))
    return s.groupBy("sample_id").agg(F.count("*").alias("n_rows"), F.countDistinct("text_lines").alias("n_texts"), F.bool_or(F.lower(F.trim("split_name")) == "eval").alias("any_eval"), tags.alias("tags"), first_psm.alias("psm"))


@query("fn_safe_id", "select distinct sample_no, regexp_replace(regexp_replace(image_path, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') as safe, regexp_replace(sample_id, '[^A-Za-z0-9._-]+', '-', 'g') as plain from samples")
def safe_ids(spark, sf):
    return read(spark, sf, "samples").select("sample_no", T.safe_id(F.col("image_path")).alias("safe"), T.safe_id(F.col("sample_id"), False).alias("plain")).distinct()


@query("fn_ocr_normalize", X.twin("items", r"select item_no, array_to_string(list_filter(list_transform(string_split(replace(replace(ocr_text, chr(13)||chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x<>''), chr(10)) as text from items where ocr_text is not null"))
def ocr_normalize(spark, sf):
    return X.items(spark, sf).where("ocr_text is not null").select("item_no", T.ocr_normalized(F.col("ocr_text")).alias("text"))


@query("fn_token_mapping", X.twin("items", "select item_no, replace(replace(replace(ocr_text, '@', 'a'), '¬', '-'), 'mm', 'm m') as text from items where ocr_text is not null"))
def token_mapping(spark, sf):
    return X.items(spark, sf).where("ocr_text is not null").select("item_no", T.replaced(F.col("ocr_text"), [("@", "a"), ("¬", "-"), ("mm", "m m")]).alias("text"))


@query("fn_normalize_ascii", X.twin("ascii", "select sample_no, trim(regexp_replace(upper(gt), '[^0-9A-Z]+', ' ', 'g')) as norm from ascii"))
def normalize_ascii(spark, sf):
    return X.ascii_samples(spark, sf).select("sample_no", T.normalized_ascii(F.col("gt")).alias("norm"))


@query("snk_box_rows", X.twin("ascii", "select sample_no, cast(i as bigint) as pos, gt[i] as ch, cast(800-10-(i%20) as bigint) as y_top from ascii, unnest(generate_series(1, length(gt))) u(i)"))
def box_rows(spark, sf):
    """One row per character with its y from the bottom."""
    s = X.ascii_samples(spark, sf).where("length(gt) > 0")
    each = s.select("sample_no", F.posexplode(F.split("gt", "")).alias("k", "ch"))
    return each.select("sample_no", (F.col("k") + 1).cast("bigint").alias("pos"), "ch", (F.lit(790) - (F.col("k") + 1) % 20).cast("bigint").alias("y_top"))


@query("snk_list_files", X.twin("ocr", "select coalesce(split,'none') as split, sample_no, row_number() over (partition by coalesce(split,'none') order by sample_no) as line_no from ocr"))
def list_files(spark, sf):
    """The lines of each split's list file, numbered; a writer parts them by split. The numbers come from ranges, not from one task a split."""
    o = X.ocr(spark, sf).select(F.coalesce("split", F.lit("none")).alias("split"), "sample_no")
    numbered = materialize(sequence_numbers(o, [F.col("split"), F.col("sample_no")]), "list-lines")
    first = numbered.groupBy("split").agg((F.min("pos") - 1).alias("before"))
    return numbered.join(F.broadcast(first), "split").select("split", "sample_no", (F.col("pos") - F.col("before")).alias("line_no"))


@query("val_eval_split", X.twin("ocr", "select count(distinct split) filter (split in ('train','eval')) = 2 as both from ocr"))
def eval_split(spark, sf):
    return X.ocr(spark, sf).agg((F.countDistinct(F.when(F.col("split").isin("train", "eval"), F.col("split"))) == 2).alias("both"))


# documents, hashes, labels


@query("src_sha256", "select doc_id, sha256(text) as sha, length(text) as n from documents where text is not null")
def sha(spark, sf):
    return read(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"), F.length("text").alias("n"))


@query("fn_sectioned_response", "with l as (select doc_id, ln, string_split(text, chr(10))[ln] as line from (select doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10))))) as ln from documents where text is not null)), k as (select *, case when regexp_matches(line, '^[A-Z][A-Za-z ]{1,30}:') then lower(replace(trim(split_part(line, ':', 1)), ' ', '_')) end as head from l), c as (select *, last_value(head ignore nulls) over (partition by doc_id order by ln rows between unbounded preceding and current row) as section from k) select doc_id, section, count(*) as n_lines, min(ln) as first from c where section is not null group by doc_id, section")
def sectioned(spark, sf):
    """Lines under the last 'Name:' header above them."""
    d = read(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line")).withColumn("ln", (F.col("k") + 1).cast("bigint"))
    head = F.when(F.col("line").rlike("^[A-Z][A-Za-z ]{1,30}:"), F.lower(F.replace(F.trim(F.substring_index("line", ":", 1)), F.lit(" "), F.lit("_"))))
    c = S.carried(d, ["doc_id"], ["ln"], head, "section").where("section is not null")
    return c.groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.min("ln").alias("first"))


@query("top_natural_sort", "select sample_no, cast(row_number() over (order by coalesce(try_cast(regexp_extract(sample_id, '([0-9]{1,15})$', 1) as bigint), 1000000000), sample_id, sample_no) as bigint) as pos from (select distinct sample_no, sample_id from samples)")
def natural_sort(spark, sf):
    s = read(spark, sf, "samples").select("sample_no", "sample_id").distinct()
    number = F.coalesce(F.expr("try_cast(regexp_extract(sample_id, '([0-9]{1,15})$', 1) as bigint)"), F.lit(1_000_000_000))
    return sequence_numbers(s.withColumn("number", number), [F.col("number"), F.col("sample_id").asc_nulls_last(), F.col("sample_no")]).select("sample_no", "pos")


def sequence_numbers(df, order):
    """df with pos, the rank over the whole table: rows are sorted in ranges, and each range counts on from those before it; no task gets all rows, whatever the keys."""
    ranged = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"))  # one row a range
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn("pos", (F.col("_own") + F.col("before")).cast("bigint")).drop("_part", "_own", "n", "before")


@query("flt_page_spec", "select b.book_id, p as page from books b, unnest(generate_series(1, coalesce(b.page_count, 0))) u(p) where p between 1 and 3 or p=7 or p between 9 and 11")
def page_spec(spark, sf):
    """The pages that '1-3,7,9-11' names, of each book."""
    from leafloom.sources.manifests import page_numbers

    wanted = F.array(*[F.lit(p).cast("bigint") for p in page_numbers("1-3,7,9-11")])
    return read(spark, sf, "books").select("book_id", F.explode(F.filter(wanted, lambda p: p <= F.coalesce("page_count", F.lit(0)))).alias("page"))


@query("agg_font_usage", "with f as (select book_id, page_count, unnest(fonts) as font from books) select split_part(font, ' ', 1) as family, coalesce(nullif(substr(font, length(split_part(font,' ',1))+2), ''), 'Regular') as style, count(distinct book_id) as n_books, cast(sum(coalesce(page_count,0)) as bigint) as pages from f group by 1, 2")
def font_usage(spark, sf):
    f = read(spark, sf, "books").select("book_id", "page_count", F.explode("fonts").alias("font"))
    family = F.substring_index("font", " ", 1)
    style = F.coalesce(F.nullif(F.expr("substring(font, length(substring_index(font, ' ', 1)) + 2)"), F.lit("")), F.lit("Regular"))
    return f.groupBy(family.alias("family"), style.alias("style")).agg(F.countDistinct("book_id").alias("n_books"), F.sum(F.coalesce("page_count", F.lit(0))).cast("bigint").alias("pages"))
