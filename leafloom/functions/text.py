"""Text columns: built-in expressions; a pandas UDF only where no built-in has the semantics."""

from __future__ import annotations

import difflib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# What marks LaTeX that needs structure, and the styles of fonts.
STRUCTURAL_LATEX = r"\\(?:frac|sqrt|sum|prod|int|begin|overline|underline|overset|underset|vec|hat|bar|left|right)|[_^].*[_^]"
FONT_STYLES = ("Regular", "Bold", "Italic", "Oblique", "Light", "Medium", "Semibold", "Black")


def filled(c: Column) -> Column:
    """null for blank text."""
    return F.nullif(F.trim(c), F.lit(""))


def first_filled(*cs: Column) -> Column:
    return F.coalesce(*[filled(c) for c in cs])


def normalized_ascii(c: Column) -> Column:
    """Upper case, everything but letters and digits one space, for ASCII text."""
    return F.trim(F.regexp_replace(F.upper(c), "[^0-9A-Z]+", " "))


def _normalized(texts: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).upper()
        return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in t).split())

    return pd.Series([one(t) for t in texts], dtype=object)


normalized = F.pandas_udf(_normalized, StringType())


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0.0 if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


similarity = F.pandas_udf(_ratio, DoubleType())


def safe_id(c: Column, strip: bool = True) -> Column:
    out = F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "-")
    return F.regexp_replace(out, "^-+|-+$", "") if strip else out


def ocr_normalized(c: Column) -> Column:
    """Line ends to \\n, runs of space to one in each line, blank lines left out."""
    lines = F.split(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != ""), "\n")


def replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Ordered replacements."""
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def render_policy(latex: Column, inline: Column) -> Column:
    """Whether a formula can be plain text: it is short, of one line and needs no structure."""
    t = F.trim(F.coalesce(latex, F.lit("")))
    plain = (t != "") & ~t.rlike(STRUCTURAL_LATEX) & (F.length(t) <= 12) & ~t.contains("\\\\")
    return F.when(plain, "text").when(inline, "inline_math").otherwise("display_math")


def without_math_marks(c: Column) -> Column:
    t = F.trim(c)
    pairs = (("$$", "$$"), ("\\[", "\\]"), ("\\(", "\\)"), ("$", "$"))
    out = t
    for a, b in reversed(pairs):
        inside = F.trim(F.substring(t, F.lit(len(a) + 1), F.length(t) - len(a) - len(b)))
        out = F.when(t.startswith(a) & t.endswith(b) & (F.length(t) >= len(a) + len(b)), inside).otherwise(out)
    return out


def font_parts(base: Column) -> Column:
    """(family, style, subset) of a base font name: subset prefix, and a known style behind the last dash; other dashes belong to the family."""
    name = F.regexp_replace(base, r"^/?(?:[A-Z]{6}\+(?=.))?", "")
    styled = f"^(.*)-({'|'.join(FONT_STYLES)})$"
    style = F.nullif(F.regexp_extract(name, styled, 2), F.lit(""))
    family = F.when(style.isNull(), name).otherwise(F.regexp_extract(name, styled, 1))
    return F.struct(F.nullif(family, F.lit("")).alias("family"), style.alias("style"), F.nullif(F.regexp_extract(base, r"^/?([A-Z]{6})\+.", 1), F.lit("")).alias("subset"))


def outline_score(text: Column, section: Column, title: Column) -> Column:
    """How well a normalised text fits an outline entry: 1 where it is its title, with or without the number; 0.79 where it is a
    longer part of the title and, for a numbered entry, begins with the number; else the likeness of the characters."""

    def of(texts: pd.Series, sections: pd.Series, titles: pd.Series) -> pd.Series:
        out = []
        for t, number, name in zip(texts, sections, titles):
            number, name = number or "", name or ""
            whole = {x for x in (name, f"{number} {name}".strip() if number else "") if x}
            if not t:
                out.append(0.0)
            elif t in whole:
                out.append(1.0)
            elif len(t) >= 10 and name and t in name and (not number or t == number or t.startswith(f"{number} ")):
                out.append(0.79)
            else:
                out.append(max((difflib.SequenceMatcher(None, t, x).ratio() for x in whole), default=0.0))
        return pd.Series(out, dtype=float)

    return F.pandas_udf(of, DoubleType())(text, section, title)


def _object(replies: pd.Series) -> pd.Series:
    def one(reply: str | None) -> str | None:
        found = (reply or "")[(reply or "").find("{") : (reply or "").rfind("}") + 1]
        try:
            return found if isinstance(json.loads(found), dict) else None
        except ValueError:
            return None

    return pd.Series([one(x) for x in replies], dtype=object)


# The JSON object in a reply, from its first to its last brace; null where there is none that is complete. The built-in parsers let pass what follows an object.
json_object = F.pandas_udf(_object, StringType())


def _payload_text(payloads: pd.Series) -> pd.Series:
    def one(payload: str | None) -> str | None:
        if payload is None:
            return None
        value = json.loads(payload)
        direct = value.get("output_text")
        if isinstance(direct, str) and direct.strip():
            return direct.strip()
        outputs = [x for x in value.get("output", []) if isinstance(x, dict) and isinstance(x.get("content", []), list)]
        parts = [part.get(key) for x in outputs for part in x.get("content", []) if isinstance(part, dict) for key in ("text", "output_text")]
        return "".join(x for x in parts if isinstance(x, str) and x.strip()).strip() or json.dumps(value, ensure_ascii=False, indent=2)

    return pd.Series([one(x) for x in payloads], dtype=object)


payload_text = F.pandas_udf(_payload_text, StringType())


def outline_level(section: Column, level: Column) -> Column:
    dotted = section.rlike(r"^\d+(\.\d+)*$")
    return F.when(dotted, F.length(section) - F.length(F.replace(section, F.lit("."), F.lit(""))) + 1).otherwise(F.greatest(F.lit(1), F.coalesce(level, F.lit(1)))).cast("bigint")


def template(c: Column, printed_page: Column, header: Column) -> Column:
    return F.replace(F.replace(c, F.lit("{printed_page}"), F.coalesce(printed_page.cast("string"), F.lit(""))), F.lit("{running_header}"), F.coalesce(header, F.lit("")))


def cp1252(data: Column) -> Column:
    """Bytes as text; the 27 places at which the code page differs from Latin-1 come from the codec itself."""
    high = bytes(range(0x80, 0xA0))
    latin = "".join(chr(b) for b in high if bytes([b]).decode("cp1252", "ignore"))
    return F.translate(F.decode(data, "ISO-8859-1"), latin, high.decode("cp1252", "ignore"))


def hex_text(c: Column) -> Column:
    """Two or more whole pairs of bytes are UTF-16, else single codes."""
    data = F.unhex(c)
    return F.when(F.length(c) % 4 == 0, F.decode(data, "UTF-16BE")).otherwise(F.decode(data, "ISO-8859-1"))
