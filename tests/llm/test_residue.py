import pytest
from pyspark.sql import functions as F

from leafloom.llm import plans, residue

BODY = "Each optical lens that reflects the beam has a mirror of 12 cm and a prism of 3 kg. The current of the coil limits the charge near the magnet. Compare the outer gauge with the inner valve, since the filter encloses it. "
CASES = [
    "404 Not Found\nThe requested mirror page does not exist.\nRequest 88", "502 Bad Gateway\nscan-proxy/3.1", "Please enable JavaScript to read the viewer.", "Hier steht später der Inhalt.\nBlindtext Blindtext Blindtext Blindtext",
    "Title: TBD\nSummary: TODO write about the lens\nText: TODO", "Hello undefined, page NaN of lens was last read on null by undefined.", "text text text text text text text text text text text text", "lorem quila amet corda lorem amet quila quila corda corda lorem amet corda quila",
    BODY + "Compare the {{plate-no}} lens.", "Let @@unit@@ be the coil.", "Dear %(reader_name)s,", "<%= page.plate %>\n" + BODY, "[INSERT LENS DESCRIPTION HERE]", "The [section] coil", "__CAPTION__", "Answer: <<answer>>", "A ${plate.no} lens", "the %unit-no% lens", "<unit here> lens",
    "Zugriff verweigert. Bitte melden Sie sich an, um den Band zu lesen. Fehler 7", "Ｐｌｅａｓｅ enable Java​Script to read",
    f"[insert {'the long name of the plate ' * 6}here] beside the lens.", "İ Please ENABLE JavaScript to continue", "{% if " + "a or " * 60 + "b %}\n" + BODY, "Activez JavaScript pour lire la page.", "Fehler 503",
]
OTHERS = [
    BODY, "", "  \n ", None, "Elastic lens", BODY + 'Typesetters fill a page with "lorem ipsum" to judge it.', BODY + "The rule writes `{running_header}` and `{printed_page}` at render time.", BODY + r"Here \frac{{x}}{{y_T}} stands beside [[REF:a-eq-0642]], an anchor.",
    BODY + "Set {1, 2, 3} and <x, y> name it; the interval [a, b] is closed and undefined at b.", BODY + 'A manifest may declare "${LENS_ROOT}".', BODY + "In the viewer, JavaScript draws the lens.", BODY + "The crawl log counted a 404 for each missing page.", BODY + "Write %s in the format string 'plate %s' and go.",
    BODY * 20 + "Please enable JavaScript to read on.",
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES + OTHERS + [CASES[0]])], "doc_id long, t string, site string")
    got = {r.row_id for r in residue.found(df, F.col("doc_id"), F.col("t")).collect()}
    assert got == {*range(len(CASES)), len(CASES) + len(OTHERS)}
    assert residue.found(df.where("false"), F.col("doc_id"), F.col("t")).count() == 0


def test_many_phrases_in_one_sentence():
    text = ", ".join(["please log in"] * 200) + "."
    _, letters, marked = residue.judge(text)
    assert letters == marked


def test_a_phrase_in_a_far_longer_sentence():
    _, [n], [marked] = residue.judge(BODY.replace(".", ",") * 10 + " it came to an internal error, and so on.")
    assert 0 < marked < 0.1 * n
    assert residue.fold("İstanbul ẞ") == "İstanbul ß" and residue.command_before("\\" + "a" * 500, 501) and not residue.command_before("frac", 4)


def test_signature_of_a_server():
    _, letters, marked = residue.judge("Downloaded 4740 times from a place.example\n502 Bad Gateway\nnginx/1.18.0")
    assert letters[1:] == marked[1:] and marked[0] == 0 and residue.judge("The ratio is\nh/2.5\nof the lens.") is None


def test_rules_make_phrases():
    made = residue.phrases()
    assert {"404 not found", "turn on javascript", "cookies sind deaktiviert", "chyba 500", "povolte skripty"} <= made and all(p == p.lower() for p in made)


def test_site_lines_are_left_aside(spark):
    text = "\n".join([*BODY.strip().split(". ")[:3], "No scan of this folio may be passed on without the desk of readers", "Session expired. Sign in."])
    df = spark.createDataFrame([(1, text)], "doc_id long, t string")
    site = spark.createDataFrame([(1, i) for i in range(4)], "row_id long, line_no long")
    args = df, F.col("doc_id"), F.col("t")
    assert residue.found(*args, min_share=0.5).count() == 0 and residue.found(*args, site, min_share=0.5).count() == 1


def test_an_error_page_served_many_times(spark):
    page = "Folio desk of the Vasdrea readers\n502 Bad Gateway: please try again later.\nRequest %d"
    texts = [page % k for k in range(8)] + [f"Folio desk of the Vasdrea readers\nPlate {'abcdefgh'[k] * 9} of the lens. {BODY}" for k in range(8)]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    site = plans.repeated_lines(df)
    assert site.where("line_no = 1 and row_id < 8").count() == 8
    got = {r.row_id for r in residue.found(df, F.col("doc_id"), F.col("text"), site).collect()}
    assert got == set(range(8))


def test_short_filler():
    import random

    rng = random.Random(3)
    latin = "lorem velum nunca rebus dolor senu vestor quila tincto corda porti orem palim amet sanda ipsum".split()
    common = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud ullamco laboris".split()
    for words in (latin, common):
        for n in (12, 20, 25, 30, 40):
            for _ in range(50):
                judged = residue.judge(" ".join(rng.choices(words, k=n)) + ".")
                assert judged and sum(judged[2]) >= 0.9 * sum(judged[1])
    other = "wozu kleb trund salp nerig bosta fimel grund laster pondu kires vamol tesch ulbar hinto dramel".split()
    found = sum(bool(residue.judge(" ".join(rng.choices(other, k=30)))) for _ in range(300))
    assert found >= 0.85 * 300
    assert residue.judge("S e r e a g e n t o f g e m k a r g a i r t n e r whenever the alloy deforms the amplitude.") is None
    assert residue.judge("The motto was: sed in et ut non est. The lens is of quartz and the mirror of tin; do it at an angle.") is None


@pytest.mark.parametrize("text", [BODY * 3000, "word " * 100_000])
def test_very_long(text):
    found = residue.judge(text)
    assert (found is None) == text.startswith("Each")
