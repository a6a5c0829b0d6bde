import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafloom.llm import scanned

CLEAN = "The hollow lens of the Vasdrea mirror separates the steady-state current. Measure the momentum at the survey before the magnet limits the friction of 368.5 kPa."
NOISY = "Tbe hollow l3ns of the Vasdrea mjrror sepa-\n- 12 -\nrates the steady-\nstate curr¬\nent. Measure the momenturn at the\nElastic plate of Danzol   13\nsurvey bef0re the rnagnet limits the fric-\ntion of 368.S kPa."


def frame(spark, rows):
    return spark.createDataFrame([(f, i, t, x, "clash") for f, i, t, x in rows], "field_name string, row_id long, t string, title string, kind string")


@pytest.fixture(scope="module")
def found(spark):
    rows = [("text", i, CLEAN, None) for i in range(40)] + [("ocr_text", 100, NOISY, None), ("ocr_text", 100, NOISY, None), ("ocr_text", 101, None, None), ("ocr_text", 102, "", None), ("ocr_text", None, NOISY, None), ("text", 103, "Elastic lens\n\nThe hollow lens separates the mirror.", "Elastic lens")]
    texts = frame(spark, rows)
    return scanned.Findings(texts), texts


def test_defects(found):
    got = {(r.field_name, r.row_id, r.line_no, r.defect) for r in found[0].defects().collect()}
    want = {(0, "char"), (0, "hyphen"), (1, "page_line"), (3, "hyphen"), (4, "char"), (5, "page_line"), (6, "char"), (6, "hyphen"), (7, "char")}
    assert got == {("ocr_text", 100, *x) for x in want}


def test_repair(found):
    f, texts = found
    rows = {r.row_id: r.t for r in f.repaired(texts.select("field_name", "row_id", "t").distinct()).where("row_id >= 100").collect()}
    assert rows[100].startswith("The hollow l3ns of the Vasdrea mirror separates the steady-state current. Measure the momentum at the survey before the magnet limits the friction of 368.5 kPa.")
    assert rows[101] is None and rows[102] == "" and "\n" not in rows[100]


def test_a_misreading_in_many_copies(spark):
    clean = [f"The lens number {k} of the hollow magnet limits the current." for k in range(8)]
    rows = [("text", k, t, None) for k, t in enumerate(clean)] + [("text", 100 + k, "Before the rnagnet of plate Danzol it is cold.", None) for k in range(50)]
    got = {(r.row_id, r.line_no, r.defect) for r in scanned.Findings(frame(spark, rows)).defects().collect()}
    assert got == {(100 + k, 0, "char") for k in range(50)}


def test_repair_without_other_marks(spark):
    wrapped = "The hollow lens of the mirror separates the\ncurrent of the coil. The gauge limits the\nmagnet."
    apart = "Elastic lens\n\nThe hollow lens separates the mirror, which was measured at the survey before the magnet was cold; then it limits the coil.\nThe gauge is cold."
    rows = [("ocr_text", 1, "The friction of 368.S kPa.", None), ("ocr_text", 2, wrapped, None), ("text", 3, "A title\n" + wrapped, None), ("text", 4, apart, None), ("ocr_text", 5, "The qu@rtz is cold.", None), ("text", 6, "The one  lens", None)]
    texts = frame(spark, rows)
    got = {r.row_id: r.t for r in scanned.Findings(texts).repaired(texts.select("field_name", "row_id", "t")).collect()}
    flat = wrapped.replace("\n", " ")
    assert got == {1: "The friction of 368.5 kPa.", 2: flat, 3: "A title\n" + flat, 4: apart, 5: "The quartz is cold.", 6: "The one  lens"}


def test_corrections_stay_at_their_line():
    fix = lambda line, word, target, score=1.0, line_2=None: {"line_no": line, "line_2": line_2, "word": word, "target": target, "score": score}
    fixes = [fix(0, "tbe", "the"), fix(1, "tbe", "tube", 2.0), fix(1, "tbe", "tune", 2.0), fix(2, "rnagnet", "magnet", line_2=3)]
    text = "Tbe lens is\nof tbe and tbe\nnear Rnag-\nnet rnagnet."
    for order in (fixes, fixes[::-1]):
        assert scanned._mend(text, order, [2], None) == "The lens is of tune and tune near Magnet rnagnet."
    assert scanned._mend("cost 1O kg\nand more\nlines", None, None, None, True) == "cost 10 kg and more lines"
    assert scanned._mend("ｗｉｄｅ", None, None, None) == "wide"


def test_vectors_are_learnt():
    """Words that stand beside the same contexts come near each other, and explain these contexts better than others."""
    rng = np.random.default_rng(1)
    kinds = rng.dirichlet(np.full(scanned.BUCKETS, 0.05), 4)
    counts = np.array([rng.multinomial(300, kinds[k % 4]) for k in range(200)], np.float32)
    noise = counts.sum(axis=0) ** 0.75
    noise = (noise / noise.sum()).astype(np.float32)
    contexts = rng.normal(scale=0.5, size=(scanned.BUCKETS, scanned.DIM)).astype(np.float32)

    def loss(w):
        x = w @ contexts.T
        share = counts / counts.sum(axis=1, keepdims=True)
        return -(share * np.log(scanned._sigmoid(x)) + scanned.NEGATIVES * noise * np.log(scanned._sigmoid(-x))).sum(axis=1).mean()

    w = scanned.word_vectors(counts, contexts, noise)
    assert loss(w) < loss(np.zeros_like(w)) - 0.2
    unit = w / np.linalg.norm(w, axis=1, keepdims=True)
    near = unit @ unit.T
    same = np.equal.outer(np.arange(200) % 4, np.arange(200) % 4)
    assert near[same].mean() > 0.9 and near[~same].mean() < near[same].mean() - 0.2


def test_context_chooses_between_links(spark):
    """'bat' leads to 'hat' and 'bah...' by form; the neighbours tell which was meant."""
    rows = [("text", k, "The steep hill near the warm lane was cold.", None) for k in range(30)] + [("text", 100 + k, "She wrote a tiny hymn for that loud choir.", None) for k in range(30)]
    rows += [("text", 200 + k, t, None) for k, t in enumerate(["The steep bill near the warm lane was cold."])]
    got = scanned.Findings(frame(spark, rows)).corrections.collect()
    assert [(r.row_id, r.word, r.target) for r in got] == [(200, "bill", "hill")] and got[0].fit > 0


def test_result_does_not_depend_on_order(spark):
    rows = [("text", i, CLEAN, None) for i in range(40)] + [("ocr_text", 100, NOISY, None)]
    texts = [frame(spark, rows), frame(spark, rows[::-1]).repartition(5)]
    a, b = [{tuple(r) for r in scanned.Findings(t).repaired(t.select("field_name", "row_id", "t")).collect()} for t in texts]
    assert a == b


def test_empty_and_long(spark):
    f = scanned.Findings(frame(spark, [("text", 1, "word-\ning " * 50_000, None)]))
    assert f.defects().where("defect = 'hyphen'").count() == 50_000 - 0
    assert scanned.Findings(frame(spark, [("text", 1, "x", None)]).where("false")).defects().count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("aceilmnrtdbh", min_size=2, max_size=9), st.integers(0, 8))
def test_an_edit_is_undone(word, at):
    for noise, true in scanned.GLYPHS.items():
        k = word.find(true, min(at, len(word) - 1))
        if k >= 0 and not set(noise) & set("|$€68"):
            misread = word[:k] + noise + word[k + len(true) :]
            assert misread == word or word in scanned.repairs(misread)


def test_furniture_shapes():
    body = ["It follows that the lens between magnet and the", "coil limits the current near the hollow vessel of", "the gauge; then it separates the survey and the"]
    for head in ("- 12 -", "xlv", "Page 7", "112", "28   AXIAL SECTION OF DRUNNAIS", "Axial section of Drunnais   28", "A X I A L   S E C T I O N   O F   D R U", "Axial section of Drunnais"):
        assert scanned.furniture([body[0], head, body[1], body[2]], None, True) == {1}, head
    assert scanned.furniture(body, None, True) == set() and scanned.furniture(["Elastic lens", "", *body], "Elastic lens", False) == set()
