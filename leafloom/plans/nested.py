"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.operators import nested
from leafloom.plans import query
from leafloom.session import read


# What stands for a list: text that holds one stands for it, also when the text is wrapped once more.
_OPENED = "case when json_type({0}) = 'VARCHAR' and json_valid({0} ->> '$') then cast({0} ->> '$' as json) else {0} end"
_ENTRIES = "case json_type(v) when 'ARRAY' then cast(v as json[]) when 'OBJECT' then [v] else [] end"
GROUPS = f"""with recursive src as (select distinct rec_id, {_OPENED.format("cast(group_tree as json)")} as v from renderable_pages where json_valid(group_tree)), top as (select rec_id, {_OPENED.format("v")} as v from src),
g(rec_id, path, parent, obj) as (select rec_id, 'group_tree[' || (i - 1) || ']', '', l[i] from (select rec_id, {_ENTRIES} as l from top), unnest(generate_series(1, len(l))) u(i) where json_type(l[i]) = 'OBJECT'
union all select rec_id, path || '.' || name || '[' || (i - 1) || ']', path, l[i] from (select rec_id, path, name, {_ENTRIES} as l from (select rec_id, path, name, {_OPENED.format("w")} as v from (select rec_id, path, name, {_OPENED.format("w")} as w from (select g.rec_id, g.path, k.name, json_extract(g.obj, '$.' || k.name) as w from g, (values ('children'), ('operation_groups')) k(name))))), unnest(generate_series(1, len(l))) u(i) where json_type(l[i]) = 'OBJECT')"""
GROUP_ID = "case when json_type(obj -> 'id') is null or json_type(obj -> 'id') = 'NULL' then '' else obj ->> 'id' end"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record once; those without an id are told apart by their tree."""
    own = read(spark, sf_dir, "renderable_pages").select("rec_id", "group_tree", F.md5("group_tree").alias("tree_key"))
    return own.dropDuplicates(["rec_id", "tree_key"])


@query("p5_found", f"{GROUPS} select distinct rec_id, path as group_path, parent as parent_path, {GROUP_ID} as group_id from g")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.groups(read(spark, sf_dir, "renderable_pages"), F.col("rec_id"), F.col("group_tree")).distinct()


@query("p5_operations", f"{GROUPS} select distinct rec_id, path as parent_path, cast(i - 1 as bigint) as position, cast(o[i] as bigint) as ordinal from (select rec_id, path, cast(obj -> 'operation_ordinals' as json[]) as o from g where json_type(obj -> 'operation_ordinals') = 'ARRAY'), unnest(generate_series(1, len(o))) u(i) where json_type(o[i]) in ('UBIGINT', 'BIGINT')")
def p5_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations of each group."""
    t = nested.tables(pages(spark, sf_dir), F.col("rec_id"), F.col("group_tree"))
    return t[nested.OPERATION].select(F.col("rec_key").alias("rec_id"), "parent_path", "position", "ordinal").distinct()


@query("p5_attributes")
def p5_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attributes of each group."""
    t = nested.tables(pages(spark, sf_dir), F.col("rec_id"), F.col("group_tree"))
    return t[nested.ATTRIBUTE].select(F.col("rec_key").alias("rec_id"), "parent_path", "name", "value").distinct()


@query("p5_tables")
def p5_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the related tables by tag, type and role, with sums that depend on every link."""
    t = nested.tables(pages(spark, sf_dir), F.col("rec_id"), F.col("group_tree"))
    group = t[nested.GROUP].groupBy(F.lit("group").alias("tbl"), F.coalesce("type", F.lit("")).alias("kind")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("parent_path") != "").alias("n_linked"))
    operation = t[nested.OPERATION].groupBy(F.lit("operation").alias("tbl"), F.lit("").alias("kind")).agg(F.count("*").alias("n_rows"), F.count("parent_path").alias("n_linked"))
    attribute = t[nested.ATTRIBUTE].groupBy(F.lit("attribute").alias("tbl"), F.col("name").alias("kind")).agg(F.count("*").alias("n_rows"), F.count("parent_path").alias("n_linked"))
    return group.unionByName(operation).unionByName(attribute)
