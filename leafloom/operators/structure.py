"""Outlines, headings, running headers: per page with small dimension tables joined to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions import text as T


def active_outline(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """(book_id, page, level, entry_no, title): per level the last entry at or before the page, unless a shallower one came later.

    entries: book_id, entry_no (list order), level, page, title; pages: book_id, page. Pages and entries run in one window
    for each book and level, so no page meets all entries of its book.
    """
    rows = pages.join(entries.select("book_id", "level").distinct(), "book_id").select("book_id", "page", "level", F.lit(1).alias("asked"), F.lit(None).cast("struct<entry_no:bigint,title:string>").alias("entry"))
    marks = entries.select("book_id", "page", "level", F.lit(0).alias("asked"), F.struct(F.col("entry_no").cast("bigint").alias("entry_no"), "title").alias("entry"))
    upto = Window.partitionBy("book_id", "level").orderBy("page", "asked").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.unionByName(marks).withColumn("entry", F.max("entry").over(upto)).where("asked = 1 and entry is not null").select("book_id", "page", "level", "entry.entry_no", "entry.title")
    shallower = Window.partitionBy("book_id", "page").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    return last.withColumn("above", F.max("entry_no").over(shallower)).where("above is null or entry_no > above").drop("above")


def headings(nodes: DataFrame, outline: DataFrame, threshold: float = 0.78) -> DataFrame:
    """(node_id, entry_no, score): the best outline entry of each text, of equal scores the longest section, then the first entry.

    nodes: node_id, book_id, text; outline: book_id, entry_no, section, title. Texts equal to an entry's title, with or
    without its number, are found by an equality join; only the rest, each different text once, meets the entries of its
    own book whose length can reach the threshold, or that it may be a part of.
    """
    n = nodes.select("node_id", "book_id", T.normalized(F.col("text")).alias("norm")).where("norm <> ''")
    o = outline.select("book_id", "entry_no", F.length(F.coalesce("section", F.lit(""))).alias("depth"), T.normalized(F.coalesce("section", F.lit(""))).alias("number"), T.normalized(F.coalesce("title", F.lit(""))).alias("name"))
    rank = F.struct("score", "depth", -F.col("entry_no"))
    forms = o.withColumn("norm", F.explode(F.array_distinct(F.array("name", F.trim(F.concat_ws(" ", "number", "name")))))).where("norm <> ''")
    best_form = forms.withColumn("score", F.lit(1.0)).groupBy("book_id", "norm").agg(F.max_by("entry_no", rank).alias("entry_no"))
    exact = n.join(best_form, ["book_id", "norm"]).select("node_id", "entry_no", F.lit(1.0).alias("score"))
    texts = n.select("book_id", "norm").distinct().join(best_form.select("book_id", "norm"), ["book_id", "norm"], "left_anti")
    size, full = F.length("norm"), F.length(F.trim(F.concat_ws(" ", "number", "name")))
    reach = lambda m: 2 * F.least(size, m) >= threshold * (size + m)
    part = (F.lit(threshold) <= 0.79) & (size >= 10) & F.col("name").contains(F.col("norm"))
    tried = texts.join(o, "book_id").where(reach(F.length("name")) | reach(full) | part)
    scored = tried.withColumn("score", T.outline_score(F.col("norm"), F.col("number"), F.col("name"))).where(F.col("score") >= threshold)
    best = scored.groupBy("book_id", "norm").agg(F.max_by("entry_no", rank).alias("entry_no"), F.max("score").alias("score"))
    return exact.unionByName(n.join(best, ["book_id", "norm"]).select("node_id", "entry_no", "score"))


def page_map(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, book_id, source_index, label, printed): the page's own label, else its index with the book's usual offset."""
    j = pages.join(labels, "page_id", "left")
    own = F.expr("try_cast(label as bigint)")
    known = j.withColumn("number", own)
    offset = known.where("number is not null").withColumn("offset", F.col("number") - F.col("source_index")).groupBy("book_id", "offset").count()
    usual = offset.groupBy("book_id").agg(F.max_by("offset", F.struct("count", -F.col("offset"))).alias("offset"))
    return known.join(usual, "book_id", "left").select("page_id", "book_id", "source_index", "label", F.coalesce("number", F.col("source_index") + F.col("offset")).alias("printed"))


def furniture(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, node_id, text): header and footer nodes from templates, even and odd pages their own. rules: side, kind, template."""
    side = F.when(F.col("printed") % 2 == 0, "even").otherwise("odd")
    j = pages.withColumn("side", side).join(F.broadcast(rules), "side")
    turn = F.row_number().over(Window.partitionBy("page_id", "kind").orderBy("template"))
    return j.withColumn("turn", turn).select("page_id", F.format_string("%s-generated-%s-%02d", "page_id", "kind", "turn").alias("node_id"), T.template(F.col("template"), F.col("printed"), F.col("header")).alias("text"))


def running_header(title: Column, fallback: Column) -> Column:
    return T.first_filled(title, fallback)
