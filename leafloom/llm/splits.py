"""Splits that keep related records together (problem 3).

Records name entities (codes); two codes named by one record belong to one component. The component table
(code -> smallest code of its component) is persisted and kept up to date by merges: links between roots hook the
larger root onto the smaller one, then pointers are jumped until every code points at its root. Each round writes its
table to the shared folder, so no round repeats another's work and a lost executor costs no more than its tasks.
save() and load() keep it, and the splits of codes and of records without one, in a folder from run to run.

Splits: a component that already has one keeps it; one that merged components of different splits is quarantined
(it keeps no split until it is decided); new components fill the deficits against the wanted shares. Components of
at least 1/2000 of the records, of which there can be no more than 2000, are placed one by one, largest first; all
others by one of 4096 hash buckets, each bucket as one. The driver sees these bounded sums only.

Codes are kept as text in which the order of texts is that of the numbers, so they may have any number of digits.

Defined results
* a record without a code (null or no match) is an entity of its own, named by its own id; a null id is the id ''.
* codes are the same whatever their case, the separator after bk and leading zeros.
* repeated rows and rows of one id count as often as they stand in the table but always come out together.
* ties go to the smaller root, then to the split that comes first by name; an empty table gives an empty table.
* extra columns play no part; texts of any length are searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.joins import with_one
from leafloom.session import materialize

CODE = r"(?<![a-z0-9])bk[^a-z0-9/\\]{0,2}0*([0-9]+)(?![0-9])"
LARGE, BUCKETS = 2000, 4096
DIGITS = 10


def ordered(digits: Column) -> Column:
    """A number's digits behind their count."""
    return F.concat(F.lpad(F.length(digits).cast("string"), DIGITS, "0"), digits)


def codes(*texts: Column) -> Column:
    """The sorted distinct book codes of some texts."""
    parts = [F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(CODE), 1) for t in texts]
    return F.array_sort(F.array_distinct(F.transform(F.concat(*parts), ordered)))


def split_name(c: Column) -> Column:
    name = F.lower(F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " ")))
    return F.when(name != "", name)


def links(coded: DataFrame) -> DataFrame:
    """(u, v), u < v: distinct links between the codes of one record; a record of n codes gives n - 1."""
    rest = coded.where(F.size("codes") > 1).select(F.get("codes", F.lit(0)).alias("u"), F.explode(F.slice("codes", F.lit(2), F.size("codes"))).alias("v"))
    return rest.distinct()


def flat(table: DataFrame) -> DataFrame:
    """Pointer jumping until each code points at its root. Roots are looked up once each, however many codes point at them."""
    while True:
        up = table.select(F.col("code").alias("root"), F.col("root").alias("up"))
        moved = materialize(table.select("root").distinct().join(up, "root").where("up <> root"), "moved-roots")
        if moved.isEmpty():
            return table
        table = materialize(with_one(table, moved, "root").select("code", F.coalesce("up", "root").alias("root")), "components")


def merge(table: DataFrame, new_codes: DataFrame, edges: DataFrame) -> DataFrame:
    """The component table (code, root) after new codes and links; root is the smallest code."""
    table = table.unionByName(new_codes.distinct().join(table, "code", "left_anti").select("code", F.col("code").alias("root")))
    table = materialize(table, "components")
    while True:
        of_u, of_v = table.select(F.col("code").alias("u"), F.col("root").alias("ru")), table.select(F.col("code").alias("v"), F.col("root").alias("rv"))
        between = with_one(with_one(edges, of_u, "u", "inner"), of_v, "v", "inner").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        edges = materialize(between, "component-links")
        if edges.isEmpty():
            return table
        hooks = materialize(edges.groupBy(F.col("v").alias("root")).agg(F.min("u").alias("to")), "component-hooks")
        table = flat(materialize(with_one(table, hooks, "root").select("code", F.coalesce("to", "root").alias("root")), "components"))


def components(coded: DataFrame, table: DataFrame | None = None) -> DataFrame:
    empty = coded.sparkSession.createDataFrame([], "code string, root string")
    return merge(empty if table is None else table, coded.select(F.explode("codes").alias("code")), links(coded))


def with_root(coded: DataFrame, table: DataFrame) -> DataFrame:
    """coded with root: null for records without a code."""
    return with_one(coded.withColumn("code", F.get("codes", F.lit(0))), table, "code").drop("code")


def key_of(root: Column) -> Column:
    digits = F.substring(root, F.lit(DIGITS + 1), F.length(root))
    return F.concat(F.lit("bk"), F.repeat(F.lit("0"), F.greatest(F.lit(7) - F.length(digits), F.lit(0))), digits)


def mixed(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows(sample_no, codes, split): (sample_no, set_key) of the samples whose set holds more than one split."""
    rooted = with_root(rows, table).where("root is not null")
    several = rooted.where("split is not null").groupBy("root").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select("root")
    return with_one(rooted, several, "root", "left_semi").select("sample_no", key_of(F.col("root")).alias("set_key")).distinct()


def fill(sizes: list[tuple[str, int]], shares: dict[str, float], taken: dict[str, int]) -> dict[str, str]:
    """Each new part, largest first, goes to the split that is furthest below its share."""
    total = sum(n for _, n in sizes) + sum(taken.values())
    norm = sum(shares.values()) or 1.0
    deficit = {s: shares[s] / norm * total - taken.get(s, 0) for s in sorted(shares)}
    out = {}
    for part, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        best = max(deficit, key=lambda s: deficit[s])
        out[part] = best
        deficit[best] -= n
    return out


def record_key(record_id: Column) -> Column:
    return F.concat(F.lit("record:"), F.coalesce(record_id.cast("string"), F.lit("")))


def given(rows: DataFrame) -> DataFrame:
    """(key, split), as persisted, of rows(record_id, codes, split) that have a split."""
    key = F.when(F.size("codes") > 0, F.get("codes", F.lit(0))).otherwise(record_key(F.col("record_id")))
    return rows.where("split is not null").select(key.alias("key"), "split").distinct()


def states(rows: DataFrame, table: DataFrame, persisted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(record_id, entity) of rows(record_id, codes), and of each entity n, root and the least and the greatest split it holds.

    persisted: (key, split) of earlier runs; a key is a code or that of a record without one. A record that has
    a code by now brings its split into the component of that code.
    """
    spark = rows.sparkSession
    own = record_key(F.col("record_id"))
    each = materialize(with_root(rows, table).select("record_id", "root", F.coalesce(key_of(F.col("root")), own).alias("entity")), "split-records")
    size = each.groupBy("entity").agg(F.count("*").alias("n"), F.first("root", True).alias("root"))
    if persisted is None:
        held = spark.createDataFrame([], "entity string, lo string, hi string")
    else:
        by_code = persisted.join(table.withColumnRenamed("code", "key"), "key").select(key_of(F.col("root")).alias("entity"), "split")
        by_record = each.select(own.alias("key"), "entity").distinct().join(persisted, "key").select("entity", "split")
        held = by_code.unionByName(by_record).groupBy("entity").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    return each.select("record_id", "entity"), materialize(size.join(held, "entity", "left"), "split-state")


def status() -> Column:
    return F.when(F.col("lo").isNull(), "new").when(F.col("lo") == F.col("hi"), "kept").otherwise("quarantined")


def assign(rows: DataFrame, table: DataFrame, plan: DataFrame, persisted: DataFrame | None = None) -> DataFrame:
    """(record_id, entity, split, status) for rows(record_id, codes). persisted: see states().

    status: kept, new or quarantined; a quarantined entity's split is null.
    """
    spark = rows.sparkSession
    each, state = states(rows, table, persisted)
    state = state.withColumn("part", F.pmod(F.xxhash64("entity"), F.lit(BUCKETS)).cast("string"))
    shares = {r.split_name: r.target_share for r in plan.groupBy(split_name(F.col("split_name")).alias("split_name")).agg(F.sum("target_share").alias("target_share")).where("split_name is not null").collect()}
    total = state.agg(F.sum("n")).first()[0] or 0
    floor = max(1, -(-total // LARGE))
    new = state.where("lo is null").withColumn("part", F.when(F.col("n") >= floor, F.col("entity")).otherwise(F.col("part")))
    taken = {r.lo: r.n for r in state.where("lo = hi").groupBy("lo").agg(F.sum("n").alias("n")).collect()}
    placed = fill([(r.part, r.n) for r in new.groupBy("part").agg(F.sum("n").alias("n")).collect()], shares, taken) if shares else {}
    chosen = spark.createDataFrame(list(placed.items()), "part string, chosen string")
    decided = new.join(F.broadcast(chosen), "part", "left").select("entity", F.col("chosen").alias("split"), status().alias("status"))
    old = state.where("lo is not null").select("entity", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("split"), status().alias("status"))
    return with_one(each, decided.unionByName(old), "entity", "inner").select("record_id", "entity", "split", "status")


def persistable(assigned: DataFrame, table: DataFrame, persisted: DataFrame | None = None) -> DataFrame:
    """(key, split) after a run: what was persisted stays as it is, so that a quarantined merge stays in doubt; new codes and records are added."""
    decided = assigned.where("split is not null").select("entity", "split").distinct()
    codes_of = table.select(F.col("code").alias("key"), key_of(F.col("root")).alias("entity"))
    rows = with_one(codes_of, decided.where("entity not like 'record:%'"), "entity", "inner").select("key", "split").unionByName(decided.where("entity like 'record:%'").select(F.col("entity").alias("key"), "split"))
    return rows if persisted is None else persisted.select("key", "split").unionByName(rows.join(persisted, "key", "left_anti"))


def _versions(spark: SparkSession, folder: str) -> list[str]:
    """The finished versions in a folder, oldest first; the components are written last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []
    return [n for n in names if n.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/components/_SUCCESS"))]


def save(folder: str, table: DataFrame, persisted: DataFrame) -> None:
    """Writes the component table and the splits as the folder's next version; a reader never sees half a version."""
    spark = table.sparkSession
    done = _versions(spark, folder)
    version = f"{folder}/{int(done[-1]) + 1 if done else 1:08d}"
    persisted.write.mode("overwrite").parquet(f"{version}/splits")
    table.write.mode("overwrite").parquet(f"{version}/components")


def load(spark: SparkSession, folder: str) -> tuple[DataFrame | None, DataFrame | None]:
    """The component table and the splits of the last version; none where there is none."""
    done = _versions(spark, folder)
    if not done:
        return None, None
    version = f"{folder}/{done[-1]}"
    return spark.read.schema("code string, root string").parquet(f"{version}/components"), spark.read.schema("key string, split string").parquet(f"{version}/splits")
