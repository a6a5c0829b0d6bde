import random
import time

import pytest
from pyspark.sql import functions as F

from leafloom import transforms as T
from leafloom.operators import content as C
from leafloom.sources import manifests

OPS = "page_id long, ordinal long, operator string, x double, y double, w double, h double, k long"


def ops(spark, rows, page=1):
    return spark.createDataFrame([(page, i, op, *(list(map(float, v)) + [None] * (4 - len(v))), i // 5) for i, (op, *v) in enumerate(rows)], OPS)


PATHS = [("BDC",), ("m", 10, 80), ("l", 30, 60), ("S",), ("EMC",), ("BDC",), ("m", 20, 60), ("l", 30, 70), ("S",), ("EMC",), ("BT",), ("Tf", 0, 0, 4), ("Tm", 12, 66), ("Tj",), ("ET",)]


def nodes(spark):
    from leafloom.functions.box import box

    rows = [(1, "r", 0, "rule", 0, 50, 100, 2, None), (1, "a", 1, "text_band", 0, 10, 50, 10, "one"), (1, "b", 2, "text_band", 0, 60, 50, 10, "two")]
    df = spark.createDataFrame(rows, "page_id long, node_id string, node_no long, type string, x long, y long, w long, h long, text string")
    return df.withColumn("b", box(F.col("x"), F.col("y"), F.col("w"), F.col("h")))


def test_cluster_owns_its_blocks(spark):
    out = T.run({"ops": ops(spark, PATHS)}, {"transforms": ["geometry.operations-into-groups.v1"]})
    g = out["groups"].collect()
    assert [(r.x, r.y, r.w, r.h) for r in g] == [(10, 60, 20, 20)]
    assert sorted(r.ordinal for r in out["group_ops"].collect()) == list(range(10))
    assert T.check(out).count() == 0


def test_text_span_moves_to_a_child(spark):
    chain = {"transforms": ["geometry.operations-into-groups.v1", "layout.associate-text-operations.v1", "layout.expand-associated-content.v1", "layout.promote-content-groups-to-one-cell-tables.v1"]}
    out = T.run({"ops": ops(spark, PATHS)}, chain)
    kinds = {r.kind for r in out["groups"].collect()}
    assert kinds == {"group", "text_operations", "table", "cell"}
    owner = {r.ordinal: r.group_id for r in out["group_ops"].collect()}
    assert len(owner) == 15 and owner[10] == owner[14] != owner[0] and T.check(out).count() == 0


@pytest.mark.parametrize("name", ["translation", "growth"])
def test_chains_run_and_keep_the_contract(spark, name):
    out = T.run({"ops": ops(spark, PATHS), "nodes": nodes(spark)}, {"transforms": T.CHAINS[name]})
    assert T.check(out).count() == 0
    assert out["units"].count() == 2 if name == "translation" else out["ops"].count() == 15 + 30


def test_every_chain_resolves():
    assert all(T.resolve(t) for chain in T.CHAINS.values() for t in chain) and len(T.REGISTRY) == 19


def test_growth_policies(spark):
    g = spark.createDataFrame([(1, "t", None, "table", 10.0, 10.0, 20.0, 20.0), (1, "c", "t", "cell", 10.0, 10.0, 20.0, 20.0), (1, "x", "c", "content", 10.0, 10.0, 40.0, 50.0)], "page_id long, group_id string, parent_id string, kind string, x double, y double, w double, h double")
    box = lambda out: {r.group_id: (r.w, r.h) for r in out["groups"].collect()}
    assert box(T.growth({"groups": g}, {}))["c"] == (40, 50) and box(T.growth({"groups": g}, {"overflow": "visible"}))["c"] == (20, 20)
    with pytest.raises(Exception, match="overflow"):
        T.growth({"groups": g}, {"overflow": "reject"})["groups"].collect()


def test_native_tables(spark):
    o = ops(spark, [("BDC",), ("re", 1, 2, 6, 6), ("m", 7, 8), ("EMC",), ("BDC",), ("m", 5, 6), ("l", 7, 8), ("EMC",)])
    s = spark.createDataFrame([(1, "T", None, "/Table", None), (1, "R", "T", "/TR", None), (1, "C", "R", "/TD", 0), (1, "D", "R", "/TD", 4), (1, "P", None, "/P", None)], "page_id long, node_id string, parent_id string, role string, mcid long")
    out = T.native_tables({"ops": o, "structure": s}, {})
    assert {(r.group_id, r.kind) for r in out["groups"].collect()} == {("T", "table"), ("R", "row"), ("C", "cell"), ("D", "cell")}
    assert "structure" not in out and {(r.group_id, r.ordinal) for r in out["group_ops"].collect()} == {("C", i) for i in range(4)} | {("D", i) for i in range(4, 8)}


def test_contract_violations(spark):
    o = ops(spark, PATHS)
    g = spark.createDataFrame([(1, "a", None, "group"), (1, "b", None, "table")], "page_id long, group_id string, parent_id string, kind string")
    claims = spark.createDataFrame([(1, "a", 0), (1, "b", 0), (1, "a", 99), (1, "a", 4)], "page_id long, group_id string, ordinal long")
    assert {r.problem for r in C.ownership(g, claims, o.unionByName(o.where("ordinal = 3"))).collect()} == {"missing_operation", "several_owners", "empty_table", "repeated_ordinal"}


def test_stack_machine_on_malformed_pages(spark):
    o = ops(spark, [("q",), ("BT",), ("Q",), ("ET",), ("EMC",), ("q",)])
    rows = {r.ordinal: (r.depth, r.parent, r.problem) for r in C.structured(o).collect()}
    assert rows[2] == (2, 1, "unmatched_scope_close") and rows[3] == (2, 1, None) and rows[4][2] == "unmatched_scope_close" and rows[0][2] == "unclosed_scope" and rows[5] == (1, 0, "unclosed_scope")


def stacked(rows):
    """ordinal, depth, parent, problem of one page, by the rule"""
    stack, out = [], []
    for ordinal, op in sorted(rows):
        if op in C.CLOSE and stack and C.OPEN[stack[-1][1]] == op:
            out.append([ordinal, len(stack), stack.pop()[0], None])
            continue
        out.append([ordinal, len(stack), stack[-1][0] if stack else None, "unmatched_scope_close" if op in C.CLOSE else None])
        stack += [(ordinal, op)] if op in C.OPEN else []
    left = {o for o, _ in stack}
    return {(o, d, s, "unclosed_scope" if o in left else x) for o, d, s, x in out}


def test_stack_machine_over_batches(spark):
    """Scopes that go on in later batches, or are left open at a page's end that comes batches later."""
    rng = random.Random(4)
    pages = {p: [(o, rng.choice(["q", "Q", "BT", "ET", "BDC", "BMC", "EMC", "m", "n", None])) for o in range(rng.choice([1, 2, 9, 40]))] for p in range(60)}
    pages[60] = [(o, "q" if o == 0 else "m") for o in range(50)]
    rows = [(p, o, op) for p, own in pages.items() for o, op in own]
    rng.shuffle(rows)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = [tuple(r) for r in C.structured(spark.createDataFrame(rows, "page_id long, ordinal long, operator string")).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == len(rows) and set(got) == {(p, *r) for p, own in pages.items() for r in stacked(own)}


def test_stack_machine_on_many_pages(spark):
    """A page costs no more than its rows: a group of its own took some 7 ms."""
    o = spark.range(100_000).selectExpr("id div 5 page_id", "id % 5 ordinal", "element_at(array('q', 're', 'f*', 'Q', 'n'), cast(id % 5 + 1 as int)) operator")
    began = time.monotonic()
    assert C.structured(o).where("parent = 0").count() == 60_000
    assert time.monotonic() - began < 30


def test_manifests():
    assert manifests.page_numbers("1-3,7") == [1, 2, 3, 7] and manifests.expand("${A}/x", {"A": "b"}) == "b/x"
    for bad in (lambda: manifests.page_numbers("3-1"), lambda: manifests.expand("${B}", {}), lambda: manifests.stages({}), lambda: manifests.stages({"transforms": [], "input": 1}), lambda: T.resolve("no.v1"), lambda: manifests.stages({"transforms": [3]})):
        with pytest.raises(manifests.ManifestError):
            bad()
