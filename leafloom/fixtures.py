"""Relations that stand for page data, from the given tables: one definition for Spark and one for the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.functions.box import box
from leafloom.session import read

SQL = {
    "nodes": "select distinct node_no, node_id, page_id, book_id, coalesce(node_type, '') as type, coalesce(node_class, '') as class, bbox.x as x, bbox.y as y, bbox.w as w, bbox.h as h, text, latex, confidence from page_nodes where bbox is not null",
    "solid": "select * from nodes where w > 0 and h > 0",
    "page_sizes": "select page_id, max(width) as width, max(height) as height from renderable_pages where page_id is not null group by page_id",
    "obstacles": "select * from solid where type in ('equation', 'image', 'diagram_component', 'table')",
    "candidate": "select node_no, node_id, page_id, book_id, case when confidence > 0.97 then 'caption' else type end as type, class, x + case when confidence > 0.9 then 3 else h % 2 end as x, y, w, h, text, latex, confidence from solid where confidence >= 0.55 union all select node_no, node_id || '-new' as node_id, page_id, book_id, type, class, x, y, w, h, text, latex, confidence from solid where confidence between 0.5 and 0.6",
    "items": "select item_no, max(item_id) as item_id, max(page_id) as page_id, max(target_node) as target_node, max(bbox.x) as x, max(bbox.y) as y, max(bbox.w) as w, max(bbox.h) as h, max(source_text) as source_text, max(ocr_text) as ocr_text, max(vision_text) as vision_text, max(vision_text_with_refs) as vision_text_with_refs, max(review_action) as review_action, max(confidence) as confidence, max(ocr_engine) as ocr_engine from review_items where item_no is not null group by item_no",
    "ops": "with r as (select l_orderkey page_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) k, l_partkey%3 kind, l_partkey%500 a, l_suppkey%300 b, cast(l_quantity as bigint) q, l_extendedprice px from lineitem), i as (select 0 i union all select 1 union all select 2 union all select 3 union all select 4) select page_id, cast((k-1)*5+i as bigint) ordinal, case when kind=0 then case i when 0 then 'BT' when 1 then 'Tf' when 2 then 'Tm' when 3 then 'Tj' else 'ET' end when kind=1 then case i when 0 then 'BDC' when 1 then 'm' when 2 then 'l' when 3 then 'S' else 'EMC' end else case i when 0 then 'q' when 1 then 're' when 2 then 'f*' when 3 then 'Q' else 'n' end end operator, cast(a as double) x, cast(b as double) y, cast(q as double) w, cast(1+q%4 as double) h, cast(k as bigint) k from r cross join i",
    "ink": "select vec_id as page_id, unnest(embedding) as v, cast(generate_subscripts(embedding, 1) - 1 as bigint) as y from embeddings",
    "crops": "select o_custkey % 20 as book, o_orderkey as page, cast(40 + o_orderkey % 11 as double) as x, cast(30 + o_orderkey % 7 as double) as y, cast(700 + o_custkey % 23 as double) as w, cast(900 + o_custkey % 31 as double) as h, cast(800 + o_orderkey % 5 as double) as img_w, cast(1000 + o_orderkey % 3 as double) as img_h, case when o_orderstatus = 'P' then 0 else 1 end as has_crop, (o_totalprice - floor(o_totalprice)) * 4 - 2 as angle from orders",
    "groups": "select 'r' || r_regionkey as group_id, cast(null as varchar) as parent_id, cast(r_regionkey as bigint) as child_idx, cast(10 * r_regionkey as bigint) as x, cast(20 as bigint) as y, cast(100 as bigint) as w, cast(50 as bigint) as h from region union all select 'n' || n_nationkey, 'r' || n_regionkey, cast(n_nationkey as bigint), 5 + n_nationkey % 7, 30 + n_nationkey % 5, 60 + n_nationkey % 9, 40 from nation union all select 's' || s_suppkey, 'n' || s_nationkey, cast(s_suppkey as bigint), 8 + s_suppkey % 13, 33 + s_suppkey % 11, 30 + s_suppkey % 50, 20 + s_suppkey % 40 from supplier",
    "ocr": "select sample_no, max(lower(trim(split_name))) as split, max(psm) as psm, max(array_to_string(text_lines, ' ')) as joined, max(tags) as tags from samples where text_lines is not null group by sample_no",
    "ascii": "select sample_no, split, tags, regexp_replace(joined, '[^ -~]', '', 'g') as gt, replace(replace(regexp_replace(joined, '[^ -~]', '', 'g'), 'th', 'tn'), 'e', 'c') as ocr_a, replace(regexp_replace(joined, '[^ -~]', '', 'g'), 'o', '0') as ocr_b from ocr",
}
NEEDS = {"solid": ["nodes"], "obstacles": ["nodes", "solid"], "candidate": ["nodes", "solid"], "ascii": ["ocr"]}


def twin(names: str, body: str) -> str:
    """A SQL twin with the named relations as leading common tables; a body that begins with 'with' adds its own."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    ctes = ", ".join(f"{n} as ({SQL[n]})" for n in order)
    return f"with {ctes}{', ' + body.strip()[5:] if body.strip().startswith('with ') else ' ' + body}" if ctes else body


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Each node once, with its box as b and as four columns."""
    raw = read(spark, sf, "page_nodes").where("bbox is not null")
    return raw.select("node_no", "node_id", "page_id", "book_id", F.coalesce("node_type", F.lit("")).alias("type"), F.coalesce("node_class", F.lit("")).alias("class"), "bbox.x", "bbox.y", "bbox.w", "bbox.h", "text", "latex", "confidence").distinct().withColumn("b", box(F.col("x"), F.col("y"), F.col("w"), F.col("h")))


def solid(spark: SparkSession, sf: str) -> DataFrame:
    return nodes(spark, sf).where("w > 0 and h > 0")


def obstacles(spark: SparkSession, sf: str) -> DataFrame:
    return solid(spark, sf).where(F.col("type").isin("equation", "image", "diagram_component", "table"))


def page_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "renderable_pages").where("page_id is not null").groupBy("page_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))


def candidate(spark: SparkSession, sf: str) -> DataFrame:
    return candidate_of(solid(spark, sf))


def candidate_of(s: DataFrame) -> DataFrame:
    """Nodes as a later run might give them: some dropped, moved, retyped and added."""
    kept = s.where("confidence >= 0.55").withColumn("type", F.when(F.col("confidence") > 0.97, "caption").otherwise(F.col("type"))).withColumn("x", F.col("x") + F.when(F.col("confidence") > 0.9, 3).otherwise(F.col("h") % 2))
    new = s.where("confidence between 0.5 and 0.6").withColumn("node_id", F.concat("node_id", F.lit("-new")))
    return kept.unionByName(new).withColumn("b", box(F.col("x"), F.col("y"), F.col("w"), F.col("h")))


def items(spark: SparkSession, sf: str) -> DataFrame:
    raw = read(spark, sf, "review_items").where("item_no is not null")
    plain = ("item_id", "page_id", "target_node", "bbox.x", "bbox.y", "bbox.w", "bbox.h", "source_text", "ocr_text", "vision_text", "vision_text_with_refs", "review_action", "confidence", "ocr_engine")
    return raw.groupBy("item_no").agg(*[F.max(c).alias(c.split(".")[-1]) for c in plain]).withColumn("b", box(F.col("x"), F.col("y"), F.col("w"), F.col("h")))


def ops(spark: SparkSession, sf: str) -> DataFrame:
    """Content-stream operations: text blocks, marked paths and filled rectangles."""
    read(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(SQL["ops"])


def ink(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("page_id"), F.posexplode("embedding").alias("y", "v")).withColumn("y", F.col("y").cast("bigint"))


def crops(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    d = lambda c: c.cast("double")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return o.select((cust % 20).alias("book"), key.alias("page"), d(40 + key % 11).alias("x"), d(30 + key % 7).alias("y"), d(700 + cust % 23).alias("w"), d(900 + cust % 31).alias("h"), d(800 + key % 5).alias("img_w"), d(1000 + key % 3).alias("img_h"), F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("has_crop"), ((F.col("o_totalprice") - F.floor("o_totalprice")) * 4 - 2).alias("angle"))


def groups(spark: SparkSession, sf: str) -> DataFrame:
    """A three-level group tree."""
    cols = lambda i, p, k, x, y, w, h: [F.concat(F.lit(i[0]), F.col(i[1]).cast("string")).alias("group_id"), (F.concat(F.lit(p[0]), F.col(p[1]).cast("string")) if p else F.lit(None).cast("string")).alias("parent_id"), F.col(k).cast("bigint").alias("child_idx"), *[F.expr(e).cast("bigint").alias(n) for e, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))]]
    a = read(spark, sf, "region").select(*cols(("r", "r_regionkey"), None, "r_regionkey", "10 * r_regionkey", "20", "100", "50"))
    b = read(spark, sf, "nation").select(*cols(("n", "n_nationkey"), ("r", "n_regionkey"), "n_nationkey", "5 + n_nationkey % 7", "30 + n_nationkey % 5", "60 + n_nationkey % 9", "40"))
    c = read(spark, sf, "supplier").select(*cols(("s", "s_suppkey"), ("n", "s_nationkey"), "s_suppkey", "8 + s_suppkey % 13", "33 + s_suppkey % 11", "30 + s_suppkey % 50", "20 + s_suppkey % 40"))
    return a.unionByName(b).unionByName(c)


def ocr(spark: SparkSession, sf: str) -> DataFrame:
    raw = read(spark, sf, "samples").where("text_lines is not null")
    return raw.groupBy("sample_no").agg(F.max(F.lower(F.trim("split_name"))).alias("split"), F.max("psm").alias("psm"), F.max(F.array_join("text_lines", " ")).alias("joined"), F.max("tags").alias("tags"))


def ascii_samples(spark: SparkSession, sf: str) -> DataFrame:
    gt = F.regexp_replace("joined", "[^ -~]", "")
    return ocr(spark, sf).select("sample_no", "split", "tags", gt.alias("gt"), F.replace(F.replace(gt, F.lit("th"), F.lit("tn")), F.lit("e"), F.lit("c")).alias("ocr_a"), F.replace(gt, F.lit("o"), F.lit("0")).alias("ocr_b"))
