import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from leafloom.llm import plans, splits
from leafloom.llm.joins import with_one
from leafloom.session import read

SF = "/root/testdata/sf0.001"


def code(n):
    digits = str(n)
    return f"{len(digits):010d}{digits}"


def brute(rows):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    coded = []
    for no, a, b, s in rows:
        cs = sorted({int(x) for t in (a, b) if t for x in re.findall(r"(?i)(?<![a-z0-9])bk[-_. ]?0*(\d+)", t)})
        coded.append((no, cs, (s or "").strip().lower() or None))
        for c in cs[1:]:
            x, y = sorted((root(cs[0]), root(c)))
            up[y] = x
    names = defaultdict(set)
    for _, cs, s in coded:
        if cs and s:
            names[root(cs[0])].add(s)
    return {(no, f"bk{root(cs[0]):07d}") for no, cs, _ in coded if cs and len(names[root(cs[0])]) > 1}


def test_whole_table(spark):
    rows = [(r.sample_no, r.sample_id, r.image_path, r.split_name) for r in read(spark, SF, "samples").collect()]
    assert {tuple(r) for r in plans.p3_found(spark, SF).collect()} == brute(rows)


def test_chains(spark):
    rng = random.Random(3)
    order = list(range(1, 60))
    rng.shuffle(order)
    rows = [(i, f"x-BK_{a:04d}", f"img/bk-{b}/p1.png", None) for i, (a, b) in enumerate(zip(order[:40], order[1:41]))]
    rows += [(100, f"bk{order[0]}", None, "Train"), (101, f"bk.{order[40]}", "", " test "), (102, f"bk{order[50]}", None, "test"), (103, f"bk{order[50]}", None, "TEST"), (104, None, None, "eval"), (105, "smp-bk", "abk7", "train")]
    df = spark.createDataFrame(rows, "sample_no long, a string, b string, split_name string")
    coded = df.select("sample_no", splits.codes(F.col("a"), F.col("b")).alias("codes"), splits.split_name(F.col("split_name")).alias("split"))
    table = splits.components(coded)
    assert {tuple(r) for r in splits.mixed(coded, table).collect()} == brute(rows) and brute(rows)
    late = spark.createDataFrame([(200, "bk1 bk9999"), (201, f"bk{order[55]} bk{order[0]}")], "sample_no long, a string").select("sample_no", splits.codes(F.col("a")).alias("codes"))
    once = {r.code: r.root for r in splits.components(coded.select("sample_no", "codes").union(late)).collect()}
    assert {r.code: r.root for r in splits.components(late, table).collect()} == once
    assert splits.components(coded.where("false")).count() == 0


def test_assignment(spark):
    plan = read(spark, SF, "split_plan")
    rows = [(i, [code(i % 300 + 1)]) for i in range(3000)] + [(3000 + i, [code(999)]) for i in range(1500)] + [(5000 + i, []) for i in range(500)] + [(None, None)]
    df = spark.createDataFrame(rows, "record_id long, codes array<string>").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    table = splits.components(df)
    out = splits.assign(df, table, plan).collect()
    assert len(out) == len(rows) and all(r.status == "new" for r in out)
    one = defaultdict(set)
    for r in out:
        one[r.entity].add(r.split)
    assert all(len(v) == 1 for v in one.values())
    share = Counter(r.split for r in out)
    assert all(abs(share[s] / len(rows) - w) < 0.01 for s, w in (("train", 0.8), ("eval", 0.1), ("test", 0.1)))
    held = spark.createDataFrame([(code(1), "test"), (code(2), "eval"), (code(3), "train")], "key string, split string")
    merged = splits.components(spark.createDataFrame([(9000, [code(2), code(3)])], "record_id long, codes array<string>"), table)
    out = {r.entity: (r.split, r.status) for r in splits.assign(df, merged, plan, held).collect()}
    assert out["bk0000001"] == ("test", "kept") and out["bk0000002"] == (None, "quarantined") and out["bk0000999"][1] == "new" and "bk0000003" not in out
    assert splits.assign(df.where("false"), table, plan).count() == 0


def test_nothing_moves_in_a_later_run(spark, tmp_path):
    """Records without a code keep their split like all others; the tables are saved and loaded."""
    plan, folder = read(spark, SF, "split_plan"), f"file://{tmp_path}/tables"
    assert splits.load(spark, folder) == (None, None)
    df = lambda rows: spark.createDataFrame(rows, "record_id long, codes array<string>")
    first = df([(i, []) for i in range(40)] + [(100 + i, [code(i)]) for i in range(40)])
    table = splits.components(first)
    before = splits.assign(first, table, plan)
    splits.save(folder, table, splits.persistable(before, table))
    later = first.unionByName(df([(200 + i, []) for i in range(59)] + [(300, [code(1), code(2)]), (39, [code(77)])]))
    table, persisted = splits.load(spark, folder)
    table = splits.components(later, table)
    after = splits.assign(later, table, plan, persisted).cache()
    was = {r.record_id: r.split for r in before.collect()}
    now = {(r.record_id, r.entity): (r.split, r.status) for r in after.collect()}
    for (i, entity), (split, status) in now.items():
        assert status == ("quarantined" if split is None else "kept" if i in was or i == 300 else "new") and (i not in was or split in (None, was[i]))
    assert now[39, "bk0000077"] == (was[39], "kept") and [k for k, v in now.items() if v[1] == "quarantined"] in ([], *[[k for k in now if k[1] == "bk0000001"]])
    splits.save(folder, table, splits.persistable(after, table, persisted))
    table, persisted = splits.load(spark, folder)
    again = splits.assign(later, splits.components(later, table), plan, persisted)
    assert {(r.record_id, r.entity): r.split for r in again.collect()} == {k: v[0] for k, v in now.items()}


def test_codes_of_any_number(spark):
    text = " ".join(f"bk{n}" for n in range(2000, 0, -1)) + " bk00012345678901234567890 bk-" + "9" * 40
    [row] = spark.createDataFrame([(text,)], "t string").select(splits.codes(F.col("t")).alias("c")).collect()
    assert row.c == [code(n) for n in [*range(1, 2001), 12345678901234567890, int("9" * 40)]]
    one = spark.createDataFrame([(1, row.c)], "record_id long, codes array<string>")
    assert {r.root for r in splits.components(one).collect()} == {code(1)}
    assert splits.links(one).count() == 2001


def test_one_row_joins_beyond_the_broadcast(spark):
    many = spark.createDataFrame([(i % 3, i) for i in range(300)] + [(None, 1)], "k long, v long")
    one = spark.createDataFrame([(k, k * 10) for k in range(2)], "k long, w long")
    for how in ("left", "inner", "left_semi"):
        want = sorted(map(str, many.join(one, "k", how).collect()))
        assert sorted(map(str, with_one(many, one, "k", how, rows=1).collect())) == want == sorted(map(str, with_one(many, one, "k", how).collect()))


def test_given_splits(spark):
    assert {"kept", "quarantined"} <= {r.status for r in plans.p3_status(spark, SF).collect()} <= {"kept", "new", "quarantined"}
    again = plans.p3_again(spark, SF).collect()
    assert all(r.split == r.first_split and r.status in ("kept", "quarantined") for r in again) and len({r.record_id for r in again}) > 100
