"""Pages as text: HTML fragments, formula text, content of groups. Ordered string aggregation, one page a row."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leafloom.functions import box as B

# Command names and their characters, letters and operators.
GREEK = {"alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "varepsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "vartheta": "ϑ", "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "upsilon": "υ", "phi": "φ", "varphi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω", "Delta": "Δ", "Sigma": "Σ", "Omega": "Ω"}
OPERATORS = {"cdot": "·", "times": "×", "pm": "±", "mp": "∓", "le": "≤", "leq": "≤", "ge": "≥", "geq": "≥", "neq": "≠", "approx": "≈", "doteq": "≐", "to": "→", "rightarrow": "→", "Rightarrow": "⇒", "leftarrow": "←", "angle": "∠", "measuredangle": "∡", "triangleleft": "◁", "sum": "∑"}
SYMBOLS = {**GREEK, **OPERATORS, "ne": "≠", "infty": "∞", "int": "∫"}
BACKGROUND = ("image", "diagram_component", "table")
_TOKEN = re.compile(r"\\([A-Za-z]+)|\\(.)|([{}^_])|(\s+)|([0-9]+(?:\.[0-9]+)?)|(.)", re.S)


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


class _Formula:
    """A small reader of formulas: groups, scripts, fractions, roots, symbols."""

    def __init__(self, text: str):
        self.tokens = [m for m in _TOKEN.finditer(text) if not m[4]]
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else None

    def argument(self) -> list:
        if self.peek() == "{":
            self.at += 1
            inner = self.row()
            if self.peek() != "}":
                raise ValueError("open group")
            self.at += 1
            return ["row", inner]
        return self.atom()

    def atom(self) -> list:
        if self.at >= len(self.tokens):
            raise ValueError("no argument")
        m = self.tokens[self.at]
        self.at += 1
        if m[1]:
            if m[1] == "frac":
                return ["frac", self.argument(), self.argument()]
            if m[1] in ("sqrt", "vec", "overline"):
                return [m[1], self.argument()]
            if m[1] in ("text", "mathrm"):
                return self.argument()
            if m[1] in SYMBOLS:
                return ["mi" if m[1] in GREEK or m[1] == "infty" else "mo", SYMBOLS[m[1]]]
            raise ValueError(m[1])
        if m[2]:
            return ["mo", m[2]]
        if m[3]:
            raise ValueError(m[3])
        return ["mn", m[5]] if m[5] else ["mi" if m[6].isalpha() else "mo", m[6]]

    def row(self) -> list:
        out = []
        while self.peek() not in (None, "}"):
            base = self.argument()
            while self.peek() in ("^", "_"):
                kind = "sup" if self.peek() == "^" else "sub"
                self.at += 1
                base = [kind, base, self.argument()]
            out.append(base)
        return out

    def whole(self) -> list:
        out = self.row()
        if self.at != len(self.tokens):
            raise ValueError("text after a group")
        return out


def _html(node: list) -> str:
    kind = node[0]
    if kind == "row":
        return "".join(map(_html, node[1]))
    if kind in ("sup", "sub"):
        return f"{_html(node[1])}<{kind}>{_html(node[2])}</{kind}>"
    if kind == "frac":
        return f"{_html(node[1])}/{_html(node[2])}"
    if kind in ("sqrt", "vec", "overline"):
        return {"sqrt": "√", "vec": "", "overline": ""}[kind] + _html(node[1]) + ("⃗" if kind == "vec" else "")
    return escape(node[1])


# One token: a command, an escaped character, or a character.
_PIECE = re.compile(r"\\([^\W\d_]+)|\\(.)?|(.)", re.S)


def _tree(text: str) -> list[list]:
    """The nodes of a formula. Every text has some: unknown commands are names, what is left open ends with the text.

    A node is [kind, ...]; open holds the nodes that still want arguments, the innermost last.
    """
    pieces = [(m[1], m[2], m[3]) for m in _PIECE.finditer(text)]
    at = 0

    def one(depth: int) -> list | None:
        """The node that begins here, without its scripts."""
        nonlocal at
        name, escaped, char = pieces[at]
        at += 1
        if char == "{":
            return ["row", row(depth + 1, True)]
        if char is None and name is None:
            return ["mo", escaped] if escaped else ["mi", "?"]
        if char is not None:
            return None if char == "}" else ["mi" if char.isalpha() else "mn" if char.isdigit() or char in ",." else "mo", char]
        if name in ("left", "right"):
            return None
        wanted = {"frac": 2, "sqrt": 1, "vec": 1}.get(name, 0)
        if wanted:
            return [name, *[argument(depth + 1) for _ in range(wanted)]]
        return ["mi", GREEK[name]] if name in GREEK else ["mo", OPERATORS[name]] if name in OPERATORS else ["mi", name]

    def scripted(base: list, depth: int) -> list:
        scripts: dict[str, list] = {}
        nonlocal at
        while at < len(pieces) and pieces[at][2] in ("_", "^"):
            mark = pieces[at][2]
            at += 1
            scripts[mark] = argument(depth + 1)
        return ["scripts", base, scripts.get("_"), scripts.get("^")] if scripts else base

    def argument(depth: int) -> list:
        nonlocal at
        while at < len(pieces) and pieces[at][2] is not None and pieces[at][2].isspace():
            at += 1
        if at == len(pieces):
            return ["nothing"]
        grouped = pieces[at][2] == "{"
        node = one(depth)
        return node if grouped else scripted(node or ["nothing"], depth)

    def row(depth: int, grouped: bool) -> list[list]:
        nonlocal at
        if depth > 150:
            raise ValueError("too deep")
        out = []
        while at < len(pieces):
            char = pieces[at][2]
            if grouped and char == "}":
                at += 1
                break
            if char is not None and char.isspace():
                at += 1
                continue
            node = one(depth)
            if node:
                out.append(scripted(node, depth))
        return out

    return row(0, False)


def _row(nodes: list[list]) -> str:
    inner = [_mathml(x) for x in nodes]
    return inner[0] if len(inner) == 1 else f"<mrow>{''.join(inner)}</mrow>"


def _mathml(node: list) -> str:
    kind = node[0]
    if kind == "row":
        return _row(node[1])
    if kind == "nothing":
        return ""
    if kind == "scripts":
        tag = "msubsup" if node[2] and node[3] else "msub" if node[2] else "msup"
        return f"<{tag}>{''.join(_mathml(x) for x in node[1:] if x)}</{tag}>"
    if kind == "frac":
        return f"<mfrac>{_mathml(node[1])}{_mathml(node[2])}</mfrac>"
    if kind == "sqrt":
        return f"<msqrt>{_mathml(node[1])}</msqrt>"
    if kind == "vec":
        return f'<mover accent="true">{_mathml(node[1])}<mo>→</mo></mover>'
    return f"<{kind}>{html.escape(node[1])}</{kind}>"


def formula_html(text: str) -> str:
    try:
        return "".join(map(_html, _Formula(text).whole()))
    except ValueError:
        return escape(text)


# What may stand about a formula.
DELIMITERS = (("$$", "$$"), ("$", "$"), ("\\(", "\\)"), ("\\[", "\\]"))


def bare(text: str) -> str:
    text = text.strip()
    for a, b in DELIMITERS:
        if text.startswith(a) and text.endswith(b):
            return text[len(a) : -len(b)].strip()
    return text


def formula_mathml(text: str) -> str:
    text = bare(text)
    try:
        inner = _row(_tree(text))
    except ValueError:
        inner = f"<mtext>{html.escape(text)}</mtext>"
    return f'<math xmlns="http://www.w3.org/1998/Math/MathML">{inner}</math>'


latex_html = lambda c: F.pandas_udf(_latex_html, StringType())(c)
latex_mathml = lambda c: F.pandas_udf(_latex_mathml, StringType())(c)


def _latex_html(s: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else formula_html(t) for t in s], dtype=object)


def _latex_mathml(s: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else formula_mathml(t) for t in s], dtype=object)


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def page_html(nodes: DataFrame) -> DataFrame:
    """(page_id, html): backgrounds first, then content, each by (y, x, node_id); types that are not drawn are left out."""
    body = F.when(F.col("type").isin("text_fragment", "caption", "heading", "header", "footer", "page_number"), escaped(F.coalesce("text", F.lit("")))).when(F.col("type") == "equation", escaped(F.coalesce("latex", F.lit("")))).when(F.col("type").isin(*BACKGROUND, "rule"), F.lit(""))
    drawn = nodes.withColumn("body", body).where("body is not null")
    layer = F.when(F.col("type").isin(*BACKGROUND), 0).otherwise(1)
    item = F.concat(F.lit('<div class="'), F.col("type"), F.lit('" style="'), B.css(F.col("b")), F.lit('">'), F.col("body"), F.lit("</div>"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct(layer.alias("layer"), "y", "x", "node_id", item.alias("item")))), lambda s: s["item"])
    return drawn.groupBy("page_id").agg(F.array_join(rows, "\n").alias("html"))
