"""Reports on pages and books, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafloom import fixtures as X
from leafloom.operators import quality as Q
from leafloom.operators import render, report
from leafloom.plans import query
from leafloom.plans.quality import DIFF, PARTS, gate_nodes, parts


def esc(c: str) -> str:
    c = f"coalesce(cast({c} as varchar), '')"
    for a, b in report.ENTITIES:
        c = f"replace({c}, '{a.replace(chr(39), chr(39) * 2)}', '{b}')"
    return c


def doc(title: str, body: str) -> str:
    return f"'<!doctype html><meta charset=\"utf-8\"><title>{title}</title><h1>{title}</h1>' || {body}"


def rows(columns: dict[str, str], order: str, title: str) -> str:
    line = "'<tr>' || " + " || ".join(f"'<td>' || {esc(c)} || '</td>'" for c in columns.values()) + " || '</tr>'"
    head = "<table><thead><tr>" + "".join(f"<th>{h}</th>" for h in columns) + "</tr></thead><tbody>"
    return "count(*) as n_rows, " + doc(title, f"'{head}' || string_agg({line}, '' order by {order}) || '</tbody></table>'") + " as html"


FINDINGS = {"Severity": "severity", "Check": "check", "Page": "page_id", "Node": "node_id", "Value": "value"}


@query("snk_quality_report", X.twin("nodes solid obstacles page_sizes", f"{PARTS}, f as (select * from bounds union all select * from classes union all select * from breaks union all select * from covered union all select * from dup), g as (select page_id, node_id, \"check\" as chk, severity, value from f) select page_id, {rows({**FINDINGS, 'Check': 'chk'}, 'severity, chk, node_id, value', 'Quality check')} from g group by page_id"))
def quality_report(spark, sf):
    """The findings of each page as a table, errors first."""
    found = list(parts(spark, sf, gate_nodes(spark, sf)).values())
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return report.table(every, "page_id", ["severity", "check", "node_id", "value"], FINDINGS, "Quality check")


CHANGES = {"Node": "node_id", "Status": "status", "Type": "type", "Moved": "moved"}


@query("snk_validation_report", X.twin("solid candidate", f"with {DIFF} select status, {rows({**CHANGES, 'Moved': 'cast(moved as bigint)'}, 'type, node_id', 'Dataset validation')} from diff where status in ('removed', 'added') or (status = 'changed' and type = 'heading') group by status, left(node_id, 9)").replace("select status, count(*)", "select left(node_id, 9) as book, status, count(*)"))
def validation_report(spark, sf):
    """What a later run lost, added and changed, by book and status."""
    d = Q.difference(X.solid(spark, sf), X.candidate(spark, sf)).where("status in ('removed', 'added') or (status = 'changed' and type = 'heading')")
    keyed = d.select(F.struct(F.substring("node_id", 1, 9).alias("book"), "status").alias("key"), "node_id", "status", "type", F.col("moved").cast("bigint").alias("moved"))
    return report.table(keyed, "key", ["type", "node_id"], CHANGES, "Dataset validation").select("key.book", "key.status", "n_rows", "html")


CARD = {"Target": "target_node", "Source text": "source_text", "OCR": "ocr_text", "Reading": "vision_text"}


@query("snk_text_review", X.twin("items", "select page_id, count(*) as n_rows, " + doc("Text review", "string_agg('<section id=\"' || " + esc("item_id") + " || '\"><h2>' || " + esc("item_id") + " || '</h2>' || " + " || ".join(f"'<h3>{h}</h3><pre>' || {esc(c)} || '</pre>'" for h, c in CARD.items()) + " || '<textarea>' || " + esc("coalesce(nullif(vision_text_with_refs,''), nullif(vision_text,''), nullif(ocr_text,''), nullif(source_text,''), '')") + " || '</textarea></section>', '' order by item_no)") + " as html from items group by page_id"))
def text_review(spark, sf):
    """A page's text segments as cards, the best reading proposed."""
    return report.cards(X.items(spark, sf), "page_id", ["item_no"], "item_id", {h: F.col(c) for h, c in CARD.items()}, ["vision_text_with_refs", "vision_text", "ocr_text", "source_text"], "Text review")


@query("snk_equation_review", X.twin("nodes", "select page_id, count(*) as n_rows, " + doc("Equation review", "string_agg('<section id=\"' || " + esc("node_id") + " || '\"><h2>' || " + esc("node_id") + " || '</h2><h3>Text</h3><pre>' || " + esc("text") + " || '</pre><h3>Formula</h3><pre>' || " + esc("case when trim(coalesce(latex,''))='' then 'No LaTeX' else '\\[' || trim(latex) || '\\]' end") + " || '</pre><textarea>' || " + esc("coalesce(nullif(latex,''), '')") + " || '</textarea></section>', '' order by node_no, node_id, coalesce(text,''), coalesce(latex,''))") + " as html from nodes where type='equation' group by page_id"))
def equation_review(spark, sf):
    """A page's formulas as cards."""
    n = X.nodes(spark, sf).where("type = 'equation'").withColumn("t", F.coalesce("text", F.lit(""))).withColumn("l", F.coalesce("latex", F.lit("")))
    shown = F.when(F.trim("l") == "", "No LaTeX").otherwise(F.concat(F.lit("\\["), F.trim("l"), F.lit("\\]")))
    return report.cards(n, "page_id", ["node_no", "node_id", "t", "l"], "node_id", {"Text": F.col("text"), "Formula": shown}, ["latex"], "Equation review")


@query("snk_structure_report", X.twin("nodes", "with s as (select book_id, page_id, count(*) filter (type='heading') as headings, count(*) filter (type in ('header','footer','page_number')) as furniture, count(*) as nodes from nodes where book_id is not null group by book_id, page_id) select book_id, " + rows({"Page": "page_id", "Headings": "headings", "Furniture": "furniture", "Nodes": "nodes"}, "page_id", "Document structure") + " from s group by book_id"))
def structure_report(spark, sf):
    """What each page of a book holds, as a table."""
    n = X.nodes(spark, sf).where("book_id is not null")
    s = n.groupBy("book_id", "page_id").agg(F.count_if(F.col("type") == "heading").alias("headings"), F.count_if(F.col("type").isin("header", "footer", "page_number")).alias("furniture"), F.count("*").alias("nodes"))
    return report.table(s, "book_id", ["page_id"], {"Page": "page_id", "Headings": "headings", "Furniture": "furniture", "Nodes": "nodes"}, "Document structure")


@query("snk_comparison", X.twin("solid candidate", "with a as (select page_id, string_agg(node_id || ' ' || x, ';' order by node_id, node_no) as t from solid where type='heading' group by page_id), b as (select page_id, string_agg(node_id || ' ' || x, ';' order by node_id, node_no) as t from candidate where type='heading' group by page_id) select page_id, " + doc("Comparison", "'<div class=\"side\">' || coalesce(a.t, '<p>missing</p>') || '</div><div class=\"side\">' || coalesce(b.t, '<p>missing</p>') || '</div>'") + " as html from a full join b using (page_id)"))
def comparison(spark, sf):
    """Headings of each page before and after, side by side."""
    def listed(n):
        item = F.concat_ws(" ", "node_id", F.col("x").cast("string"))
        return n.where("type = 'heading'").groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "node_no", item.alias("i")))), lambda r: r["i"]), ";").alias("html"))

    return report.side_by_side(listed(X.solid(spark, sf)), listed(X.candidate(spark, sf)), "page_id", "Comparison")


@query("snk_page_comparison")
def page_comparison(spark, sf):
    """Whole pages before and after, side by side; the page renderer has a twin of its own."""
    return report.side_by_side(render.page_html(X.solid(spark, sf)), render.page_html(X.candidate(spark, sf)), "page_id", "Comparison")
