import json

from pyspark.sql import functions as F

from leafloom.operators import nested


def rows(spark, trees):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(trees)], "rec_id long, group_tree string, tag int")
    return {(r.rec_id, r.group_path, r.parent_path, r.group_id) for r in nested.groups(df, F.col("rec_id"), F.col("group_tree")).collect()}


def test_shapes(spark):
    got = rows(
        spark,
        [
            json.dumps([{"id": "a", "children": [None, {"id": 7}, "x", {"id": None, "operation_groups": json.dumps([1, {"id": "t"}])}]}]),
            json.dumps({"id": "lone", "children": {"id": 1.5}, "attributes": {"children": [{"id": "no"}]}}),
            None, "", "  ", "null", "[]", "3", '[{"id": "cut", "chil', json.dumps([{"children": 4, "operation_groups": "[{"}]), json.dumps(json.dumps([{"id": "again"}])),
        ],
    )
    assert got == {
        (0, "group_tree[0]", "", "a"), (0, "group_tree[0].children[1]", "group_tree[0]", "7"), (0, "group_tree[0].children[3]", "group_tree[0]", ""),
        (0, "group_tree[0].children[3].operation_groups[1]", "group_tree[0].children[3]", "t"),
        (1, "group_tree[0]", "", "lone"), (1, "group_tree[0].children[0]", "group_tree[0]", "1.5"),
        (9, "group_tree[0]", "", ""), (10, "group_tree[0]", "", "again"),
    }


def test_any_depth():
    depth = 30_000
    text = '{"children":[' * depth + "1" + "]}" * depth
    assert sum(1 for _ in nested.visit(text)) == depth
    for bad in ("[1", "[1,]", '{"a":}', '{"a" 1}', "[1] 2", "[tru]", '{1:2}'):
        try:
            nested._parse_deep(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    for good in ("[]", '{"a":[1,-2.5e3,true,null,"x\\n"],"b":{}}', " 3 "):
        assert nested._parse_deep(good) == json.loads(good)


def test_tables(spark):
    tree = json.dumps([{"id": "a", "type": "group", "bbox": {"x": 1, "y": "2", "w": None}, "operation_ordinals": [3, 4, "x"], "attributes": {"alt": "A", "n": 1}}])
    df = spark.createDataFrame([(1, tree)], "rec_id long, group_tree string")
    t = nested.tables(df, F.col("rec_id"), F.col("group_tree"))
    assert [(r.type, r.x, r.y, r.w) for r in t["group"].collect()] == [("group", 1.0, 2.0, None)]
    assert sorted(r.ordinal for r in t["operation"].collect()) == [3, 4]
    assert {(r.name, r.value) for r in t["attribute"].collect()} == {("alt", "A"), ("n", "1")}
    assert t["group"].where("false").count() == 0 and nested.groups(df.where("false"), F.col("rec_id"), F.col("group_tree")).count() == 0


def test_tags_are_read_from_their_own_folders(spark):
    df = spark.createDataFrame([(1, json.dumps([{"id": "a", "operation_ordinals": [2 ** 70, 5]}]))], "rec_id long, group_tree string")
    t = nested.tables(df, F.col("rec_id"), F.col("group_tree"))
    assert "PartitionFilters: [isnotnull(tag" in t["operation"]._jdf.queryExecution().toString()
    assert sorted(str(r.ordinal) for r in t["operation"].collect()) == ["5", "None"]


def test_records_without_an_id(spark, tmp_path):
    from leafloom.plans.nested import pages

    trees = [json.dumps([{"id": x}]) for x in "abb"]
    spark.createDataFrame([(None, t) for t in trees] + [(1, trees[0]), (1, trees[0])], "rec_id long, group_tree string").write.parquet(f"{tmp_path}/renderable_pages.parquet")
    assert pages(spark, str(tmp_path)).count() == 3
