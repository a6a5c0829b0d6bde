"""Reports as text: tables of findings, cards for review, pages side by side. One document a page or book, so none grows with the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands for a character in HTML.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def escaped(c: Column) -> Column:
    """The text in HTML; null is the empty text."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, F.coalesce(c.cast("string"), F.lit("")))


def element(name: str, *inner: Column, attributes: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{attributes}>"), *inner, F.lit(f"</{name}>"))


def document(title: Column | str, *body: Column) -> Column:
    name = escaped(F.lit(title) if isinstance(title, str) else title)
    return F.concat(F.lit('<!doctype html><meta charset="utf-8"><title>'), name, F.lit("</title><h1>"), name, F.lit("</h1>"), *body)


def in_order(rows: DataFrame, key: str, order: list[str], item: Column) -> DataFrame:
    """(key, body, n_rows): the items of each key one after the other."""
    each = rows.select(key, F.struct(*order, item.alias("_item")).alias("_row"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("_row")), lambda r: r["_item"]), "")
    return each.groupBy(key).agg(body.alias("body"), F.count("*").alias("n_rows"))


def table(rows: DataFrame, key: str, order: list[str], columns: dict[str, str], title: str) -> DataFrame:
    """(key, n_rows, html): a table of the rows of each key. columns: headings to columns."""
    line = element("tr", *[element("td", escaped(F.col(c))) for c in columns.values()])
    head = F.lit("<table><thead><tr>" + "".join(f"<th>{h}</th>" for h in columns) + "</tr></thead><tbody>")
    return in_order(rows, key, order, line).select(key, "n_rows", document(title, head, F.col("body"), F.lit("</tbody></table>")).alias("html"))


def cards(items: DataFrame, key: str, order: list[str], name: str, fields: dict[str, Column], proposed: list[str], title: str) -> DataFrame:
    """(key, n_rows, html): a card for each item with its fields and, to be edited, the first of the proposed texts that is not empty."""
    first = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in proposed], F.lit(""))
    parts = [F.concat(element("h3", F.lit(h)), element("pre", escaped(c))) for h, c in fields.items()]
    card = F.concat(F.lit('<section id="'), escaped(F.col(name)), F.lit('">'), element("h2", escaped(F.col(name))), *parts, element("textarea", escaped(first)), F.lit("</section>"))
    return in_order(items, key, order, card).select(key, "n_rows", document(title, F.col("body")).alias("html"))


def side_by_side(left: DataFrame, right: DataFrame, key: str, title: str) -> DataFrame:
    """(key, html) of left and right, each (key, html); a page that one side lacks says so."""
    a, b = left.select(key, F.col("html").alias("_a")), right.select(key, F.col("html").alias("_b"))
    side = lambda c: element("div", F.coalesce(F.col(c), F.lit("<p>missing</p>")), attributes=' class="side"')
    return a.join(b, key, "full_outer").select(key, document(title, side("_a"), side("_b")).alias("html"))
