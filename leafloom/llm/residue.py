"""Template residue, filler and error-page text (problem 9).

One automaton holds the phrases of all languages, listed or made by rules; one expression holds the shapes of unfilled
placeholders, whose names are open. A text's sentences that carry a phrase outside quotes (a phrase speaks for up to
SPEAKS_FOR times its letters), windows of words with hardly any variety or of filler words, and empty fields count as residue. A document is excluded when it has a placeholder where content belongs, or when residue
covers at least min_share of its letters, site lines (those repeated within the source) left aside.

Defined results
* null, empty and blank texts are no case; an empty table gives an empty table.
* quoted or marked-up mentions (quotes, backticks, formulas, anchors) are no placeholders and no phrases.
* repeated rows are judged alike; extra columns play no part; texts of any length are judged whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.llm.canon import canonical

MIN_SHARE = 0.2

# Reasons of failed requests by status code.
STATUS = {400: "bad request", 401: "unauthorized", 403: "forbidden", 404: "not found", 405: "method not allowed", 408: "request timeout", 410: "gone", 429: "too many requests", 500: "internal server error", 502: "bad gateway", 503: "service unavailable", 504: "gateway timeout"}
# What a page asks for, and what of: verbs, things, and verbs that follow the thing, by language.
DEMANDS = (
    ("enable | turn on | switch on | activate | allow | accept | requires | needs | need | please enable", "javascript | scripts | scripting | cookies", "is disabled | is required | is turned off | are disabled | are required | switched on | enabled to"),
    ("povolte | zapněte | aktivujte | vyžaduje | potřebuje", "javascript | skripty | cookies | soubory cookie", "je vypnutý | je vypnut | je zakázán | jsou vypnuty | jsou zakázány"),
    ("aktivieren sie | erlauben sie | akzeptieren sie | benötigt | erfordert | braucht", "javascript | skripte | cookies", "aktivieren | akzeptieren | zulassen | ist deaktiviert | sind deaktiviert"),
    ("activez | autorisez | acceptez | nécessite", "javascript | les scripts | les cookies", "est désactivé | sont désactivés"),
    ("active | habilite | acepte | requiere", "javascript | las cookies", "está desactivado | están desactivadas"),
)
# How an error is named before its code.
ERRORS = "error | http | http error | status | chyba | fehler | erreur | errore"
# Phrases of error pages, access notices and filler, lower case.
PHRASES = """
bad gateway | gateway timeout | internal server error | internal error | service unavailable | temporarily unavailable | an error occurred | something went wrong | error id | traceback id | too many requests | rate limit exceeded
page not found | the requested | page does not exist | could not be found | we could not find | you were looking for | nothing was found here | no longer available | please retry later | please try again later | wait a moment and | try the start page | return to the home page | go back to the homepage
session expired | your session has | sign in again | please sign in | please log in | log in to continue | sign in to continue | access denied | permission denied | you do not have permission | access forbidden
scripting in your browser | checking your browser | verify you are human | complete the captcha | unusual traffic
lorem ipsum | dolor sit amet | consectetur adipiscing | blah blah | sample text | text goes here | placeholder text | dummy text | content goes here | coming soon | under construction | to be added | test test test
stránka nenalezena | stránka nebyla nalezena | vraťte se na | interní chyba | přístup odepřen | přístup zamítnut | přihlaste se | relace vypršela | příliš mnoho požadavků | služba není dostupná | zkuste to později | povolte ve svém prohlížeči
zde bude | sem vložte | ukázkový text | obsah se připravuje | stránka se připravuje | doplnit text | text bude doplněn
seite nicht gefunden | seite wurde nicht gefunden | nicht gefunden | interner fehler | interner serverfehler | zugriff verweigert | zugriff nicht erlaubt | bitte melden sie sich an | sitzung abgelaufen | zu viele anfragen | nicht verfügbar | versuchen sie es später | bitte aktivieren sie
hier steht später | hier steht bald | blindtext | platzhaltertext | beispieltext | inhalt folgt | text folgt | hier entsteht
page introuvable | accès refusé | session expirée | veuillez vous connecter | contenu à venir | página no encontrada | acceso denegado | sesión caducada | inicie sesión | próximamente | texto de ejemplo
"""


def _cells(text: str) -> list[str]:
    return [p.strip() for line in text.splitlines() for p in line.split("|") if p.strip()]


def phrases() -> set[str]:
    """The phrases, and those that the rules above make."""
    out = set(_cells(PHRASES))
    out |= {f"{code} {reason}" for code, reason in STATUS.items()} | {f"{name} {code}" for name in _cells(ERRORS) for code in STATUS}
    for before, things, after in DEMANDS:
        for thing in _cells(things):
            out |= {f"{verb} {thing}" for verb in _cells(before)} | {f"{thing} {verb}" for verb in _cells(after)}
    return out


_NAME = r"[A-Za-z][\w.\-]*"
# The shapes of placeholders.
PLACEHOLDER = re.compile(
    rf"""\{{\{{\{{?\s*{_NAME}(?:\ {_NAME})*\s*\}}?\}}\}} | \{{%-?\s*\w[^%\n]*%\}} | <%[=-]?[^%\n]+%> | [$\#]\{{\s*{_NAME}\s*\}}
    | \[\[\s*{_NAME}(?:\ {_NAME})*\s*\]\] | <<\s*{_NAME}(?:\ {_NAME})*\s*>> | @@{_NAME}@@ | (?<!\w)__[A-Za-z][A-Za-z0-9_]*?__(?!\w)
    | (?<![\w%])%{{1,2}}[A-Za-z][\w.\-]+%{{1,2}}(?![\w%]) | %\([A-Za-z]\w*\)[sdfr] | \{{[A-Za-z][\w.\-]*\w\}} | <{_NAME}(?:\ {_NAME})*\ here>
    | \[(?i:insert|your|enter|add|vložte|doplňte|sem|einfügen|hier)\b[^\]\n]*\] | \[[A-Za-z]{{3,}}(?:[._\-]?[A-Za-z]+)*\](?!\()""",
    re.X,
)
NO_PLACEHOLDER = {"[sic]", "[note]", "[notes]", "[edit]", "[citation]", "[ref]", "[eds]", "[abstract]", "[online]"}
EMPTY_FIELD = re.compile(r"\s*[^\W\d_][\w ]*:\s*(?:(?:TBD|TBA|TODO|FIXME|XXX+|N/A)\b|\?\?\?+|\.\.\.$)|\s*(?:TBD|TODO|FIXME)\b")
FIELD_MARKS = ("TBD", "TBA", "TODO", "FIXME", "XX", "N/A", "??", "...")
# What a server signs an error page with: a name and a version, alone in its line.
SIGNATURE = re.compile(r"\s*[A-Za-z][\w\-]*/\d+(?:\.\d+)+\s*$")
UNSET = re.compile(r"\b(?:undefined|NaN|null|None)\b|\[object Object\]")
SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?](?!\s|$)[^.!?\n]*)*[.!?]*")
WORD = re.compile(r"[^\W\d_]+")
QUOTES = "\"'`„“”‚‘’«»"
SPEAKS_FOR = 10
WINDOW, VARIETY, FEWEST = 40, 0.45, 8
SHORT, MOST_VARIETY = 20, 0.6

# Words of filler; those after the bar are words of real texts as well and count beside the others only.
LATIN, SMALL = (
    frozenset(x.split())
    for x in """
lorem ipsum dolor amet consectetur consectetuer adipiscing adipisicing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum
vestibulum pellentesque praesent curabitur suspendisse phasellus aenean vivamus maecenas donec etiam fusce integer nullam quisque vehicula sagittis tincidunt ultrices ultricies vulputate facilisis fringilla hendrerit imperdiet interdum lacinia lacus laoreet lectus libero ligula lobortis luctus malesuada massa mattis mauris metus molestie morbi nibh nunc odio orci ornare pharetra placerat porta porttitor posuere pretium proin purus quam risus rhoncus rutrum sapien scelerisque sodales sollicitudin tellus tempus tortor turpis urna varius venenatis viverra volutpat accumsan aliquam aliquet ante arcu augue bibendum blandit condimentum congue convallis cras cursus dapibus dictum dignissim egestas eget eleifend elementum erat eros euismod faucibus felis fermentum feugiat gravida iaculis justo leo
orem velum vestor quila nunca palim sanda rebus porti tincto corda senu
|
sit sed do ut et ad ex ea in eu non qui id est ac at nec vel per pro quisquam neque a
""".split("|")
)


class Phrases:
    def __init__(self, listed: set[str] | None = None):
        self.automaton = ahocorasick.Automaton()
        for phrase in phrases() if listed is None else listed:
            self.automaton.add_word(phrase, len(phrase))
        self.automaton.make_automaton()

    def spans(self, lower: str) -> list[tuple[int, int]]:
        """Where phrases stand outside quotes, in order, those that overlap as one."""
        found: list[tuple[int, int]] = []
        for last, size in self.automaton.iter(lower):
            a, b = last + 1 - size, last + 1
            before, after = lower[a - 1 : a], lower[b : b + 1]
            if (before and before in QUOTES) or (after and after in QUOTES) or (before.isalnum() and lower[a].isalnum()) or (after.isalnum() and lower[b - 1].isalnum()):
                continue
            while found and a <= found[-1][1]:
                a = min(a, found.pop()[0])
            found.append((a, b))
        return found


def fold(text: str) -> str:
    """Lower case, place by place: what has more than one character in lower case stays."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


_phrases: list[Phrases] = []


def command_before(text: str, at: int) -> bool:
    """Whether a command of a formula, a backslash and letters, ends at a place."""
    k = at
    while k and text[k - 1].isascii() and text[k - 1].isalpha():
        k -= 1
    return 0 < k < at and text[k - 1] == "\\"


def placeholder(text: str) -> bool:
    for m in PLACEHOLDER.finditer(text):
        before, after = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
        if (before and before in QUOTES + "\\}^_") or (after and after in QUOTES + "{") or m.group().lower() in NO_PLACEHOLDER:
            continue
        if m.group()[0] == "{" and command_before(text, m.start()):
            continue
        return True
    return False


def filler(words: list[str]) -> bool:
    """Whether some words have hardly any variety; fewer words repeat less by chance, so the bound is wider for them."""
    n = len(words)
    if n < FEWEST:
        return False
    different = len(set(words))
    if different <= max(2, VARIETY * n):
        return True
    longer = [w for w in words if len(w) > 1] if n >= SHORT and different <= MOST_VARIETY * n else []  # spaced letters vary little
    return len(longer) >= SHORT and len(set(longer)) <= min(MOST_VARIETY, VARIETY + 0.01 * (WINDOW - len(longer))) * len(longer)


def latin(words: list[str]) -> set[int]:
    """The places of words in runs of FEWEST (or all of at least 4) words of which three in four are words of filler."""
    size = min(FEWEST, len(words))
    plain = [w.strip(".,;:!?()-") for w in words]
    if size < 4 or LATIN.isdisjoint(plain):
        return set()
    own = [w in LATIN for w in plain]
    each = [a or w in SMALL for a, w in zip(own, plain)]
    marked: set[int] = set()
    n_each, n_own = sum(each[:size]), sum(own[:size])
    for k in range(len(words) - size + 1):
        if k:
            n_each += each[k + size - 1] - each[k - 1]
            n_own += own[k + size - 1] - own[k - 1]
        if 4 * n_each >= 3 * size and 2 * n_own >= size:
            marked.update(range(k, k + size))
    return marked


def judge(text: str) -> tuple[bool, list[int], list[int]] | None:
    """(placeholder, letters, residue letters) by line; None where there is no sign of residue."""
    text = canonical(text)
    if not text.strip():
        return None
    if not _phrases:
        _phrases.append(Phrases())
    lower = fold(text)
    spans = _phrases[0].spans(lower)
    open_field = any(c in text for c in "{[<@%_#") and placeholder(text)
    lines = text.split("\n")
    residue = [0] * len(lines)
    letters: list[int] | None = None
    unset = any(w in text for w in ("undefined", "NaN", "null", "None", "[object")) and len(UNSET.findall(text)) > 1
    fields = [(i, m.end()) for i, x in enumerate(lines) if (m := EMPTY_FIELD.match(x))] if any(mark in text for mark in FIELD_MARKS) else []
    words = lower.split()
    thin = [k for k in range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2) if filler(words[k : k + WINDOW])]
    marked = latin(words)
    if not (spans or open_field or unset or fields or thin or marked):
        return None
    letters = [sum(map(len, WORD.findall(x))) for x in lines]
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    if spans or unset:
        k = 0
        for i, x in enumerate(lines):
            if spans and SIGNATURE.match(x):
                residue[i] = letters[i]
                continue
            for m in SENTENCE.finditer(x):
                a, b = starts[i] + m.start(), starts[i] + m.end()
                while k < len(spans) and spans[k][1] <= a:
                    k += 1
                inside = []
                for j in range(k, len(spans)):
                    if spans[j][0] >= b:
                        break
                    inside.append((max(a, spans[j][0]), min(b, spans[j][1])))
                own = sum(map(len, WORD.findall(m.group())))
                if len(UNSET.findall(m.group())) > 1:
                    residue[i] += own
                elif inside:  # a phrase speaks for its sentence, if that is not far longer
                    residue[i] += min(own, SPEAKS_FOR * sum(sum(map(len, WORD.findall(lower[x:y]))) for x, y in inside))
    for i, end in fields:  # with what it asks for
        own = sum(map(len, WORD.findall(lines[i][:end])))
        residue[i] = max(residue[i], min(SPEAKS_FOR * own, own + sum(map(len, WORD.findall(re.split(r"[.!?]", lines[i][end:], maxsplit=1)[0])))))
    if thin or marked:
        for k in thin:
            marked.update(range(k, min(len(words), k + WINDOW)))
        at = 0
        for i, x in enumerate(lines):
            own = x.lower().split()
            covered = sum(sum(map(len, WORD.findall(w))) for j, w in enumerate(own, at) if j in marked)
            at += len(own)
            residue[i] = max(residue[i], covered)
    return open_field, letters, [min(a, b) for a, b in zip(residue, letters)]


def signs(df: DataFrame, row: Column, text: Column) -> DataFrame:
    """(row_id, open_field, letters, residue) of the rows with any sign; only these move on."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *found) for i, t in zip(batch["row_id"], batch["t"]) if (found := judge(t))]
            if rows:
                yield pd.DataFrame(rows, columns=["row_id", "open_field", "letters", "residue"])

    source = df.select(row.cast("bigint").alias("row_id"), text.alias("t")).where("row_id is not null and t is not null")
    return source.mapInPandas(emit, "row_id bigint, open_field boolean, letters array<bigint>, residue array<bigint>")


def found(df: DataFrame, row: Column, text: Column, site_lines: DataFrame | None = None, min_share: float = MIN_SHARE) -> DataFrame:
    """(row_id, share): the residue documents. site_lines: (row_id, line_no) of which only the residue counts."""
    judged = signs(df, row, text)
    if site_lines is None:
        judged = judged.withColumn("site", F.array().cast("array<bigint>"))
    else:
        judged = judged.join(site_lines.groupBy("row_id").agg(F.collect_set("line_no").alias("site")), "row_id", "left").withColumn("site", F.coalesce("site", F.array().cast("array<bigint>")))

    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)

    counted = F.transform("letters", lambda x, i: F.when(F.array_contains("site", i.cast("bigint")), F.get("residue", i)).otherwise(x))
    share = total(F.col("residue")) / F.greatest(total(counted), F.lit(1))
    return judged.withColumn("share", share).where(F.col("open_field") | (F.col("share") >= min_share)).groupBy("row_id").agg(F.max("share").alias("share"))
