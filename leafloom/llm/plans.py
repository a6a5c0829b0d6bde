"""Queries of the text problems and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm import canon, leaks, overlap, packing, repeated, residue, scanned, splits, sql
from leafloom.llm.joins import with_one
from leafloom.session import materialize, read, scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"p1_found": sql.P1, "p2_found": sql.P2, "p3_found": sql.P3, "p3_status": sql.P3_STATUS, "p4_found": sql.P4, "p8_found": sql.P8}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


TEXTS = {"documents": ("doc_id", "text"), "review_items": ("item_no", "vision_text")}


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [canon.pairs(canon.keys(read(spark, sf_dir, t), F.col(i), F.col(x))).select(F.lit(t).alias("tbl"), "id_a", "id_b") for t, (i, x) in TEXTS.items()]
    return found[0].unionByName(found[1])


@query
def p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its one form."""
    texts = [canon.canonicalize(read(spark, sf_dir, t).select(F.lit(t).alias("tbl"), F.col(i).alias("row_id"), F.col(x).alias("text")), "text") for t, (i, x) in TEXTS.items()]
    return texts[0].unionByName(texts[1])


def repeated_lines(documents: DataFrame) -> DataFrame:
    return repeated.found(documents, F.col("source"), F.col("doc_id"), F.col("doc_id"), F.col("text"))


def repeated_nodes(nodes: DataFrame) -> DataFrame:
    return repeated.found(nodes, F.col("book_id"), F.col("page_id"), F.col("node_no"), F.col("text"), split=False)


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = repeated_lines(read(spark, sf_dir, "documents")).select(F.lit("documents").alias("tbl"), "row_id", "line_no")
    nodes = repeated_nodes(read(spark, sf_dir, "page_nodes")).select(F.lit("page_nodes").alias("tbl"), "row_id", "line_no")
    return documents.unionByName(nodes)


@query
def p2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts without their repeated lines."""
    documents, nodes = read(spark, sf_dir, "documents"), read(spark, sf_dir, "page_nodes")
    source, doc = F.col("source"), F.col("doc_id")
    _, kept = repeated.tried_and_kept(documents, source, doc, doc, F.col("text"))
    a = repeated.remove(documents.select("source", "doc_id", "text"), source, doc, "text", kept)
    book, page = F.col("book_id"), F.col("page_id")
    _, kept = repeated.tried_and_kept(nodes, book, page, F.col("node_no"), F.col("text"), split=False)
    b = repeated.remove(nodes.select("book_id", "page_id", "node_no", "text"), book, page, "text", kept, split=False)
    b = b.select("node_no", "text").distinct()
    return a.select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("row_id"), "text").unionByName(b.select(F.lit("page_nodes").alias("tbl"), F.col("node_no").alias("row_id"), "text"))


def coded_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = read(spark, sf_dir, "samples")
    return samples.select("sample_no", splits.codes(F.col("sample_id"), F.col("image_path")).alias("codes"), splits.split_name(F.col("split_name")).alias("split"))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = coded_samples(spark, sf_dir)
    return splits.mixed(coded, splits.components(coded))


def given_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_samples(spark, sf_dir).withColumnRenamed("sample_no", "record_id").distinct()


@query
def p3_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every sample its set, whether that keeps its given split, is new or holds several, and the split kept."""
    rows = given_samples(spark, sf_dir)
    each, state = splits.states(rows, splits.components(rows), splits.given(rows))
    kept = state.select("entity", splits.status().alias("status"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("kept_split"))
    return with_one(each, kept, "entity", "inner").select(F.col("record_id").alias("sample_no"), F.col("entity").alias("set_key"), "status", "kept_split").distinct()


@query
def p3_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample with its set and the split it shall be in: given splits are kept, new sets fill the deficits."""
    rows = given_samples(spark, sf_dir)
    return splits.assign(rows, splits.components(rows), read(spark, sf_dir, "split_plan"), splits.given(rows))


@query
def p3_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs with the tables saved between them: every sample's split after the first and after the second, which keeps all that was decided."""
    rows, plan, folder = given_samples(spark, sf_dir), read(spark, sf_dir, "split_plan"), scratch_folder(spark, "split-tables")
    table = splits.components(rows)
    first = materialize(splits.assign(rows, table, plan, splits.given(rows)), "split-first")
    splits.save(folder, table, splits.persistable(first, table, splits.given(rows)))
    table, persisted = splits.load(spark, folder)
    second = splits.assign(rows, splits.components(rows, table), plan, persisted)
    before = first.select("record_id", F.col("split").alias("first_split")).distinct()
    return second.join(before, "record_id").select("record_id", "entity", "first_split", "split", "status").distinct()


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return residue.found(documents, F.col("doc_id"), F.col("text"), repeated_lines(documents)).select(F.col("row_id").alias("doc_id"))


@query
def p9_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are left."""
    documents = read(spark, sf_dir, "documents")
    return documents.select("doc_id", "text").join(p9_found(spark, sf_dir), "doc_id", "left_anti")


def leaked(spark: SparkSession, sf_dir: str, edits: bool = False) -> DataFrame:
    return leaks.leaks(read(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"), read(spark, sf_dir, "test_items"), edits=edits)


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned documents and items; of these the ones with so many consecutive words."""
    return leaked(spark, sf_dir).where(F.col("run") >= leaks.MIN_WORDS).select(F.col("row_id").alias("doc_id"), "item_id")


@query
def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items leaked, exactly or edited, into how many documents."""
    found = leaked(spark, sf_dir, edits=True).where((F.col("run") >= leaks.MIN_WORDS) | (F.col("share") >= 0.5))
    items = read(spark, sf_dir, "test_items").select("item_id", "suite")
    return found.join(items, "item_id").groupBy("suite", "item_id").agg(F.countDistinct("row_id").alias("n_docs"), F.count_if(F.col("run") >= leaks.MIN_WORDS).alias("n_exact"), F.max("share").alias("best_share"))


def page_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The texts that may carry a scan's noise, and the reviewed readings, which only count."""
    documents, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "review_items")
    texts = documents.select(F.lit("text").alias("field_name"), F.col("doc_id").alias("row_id"), F.col("text").alias("t"), "title")
    for field in ("ocr_text", "source_text"):
        texts = texts.unionByName(items.select(F.lit(field).alias("field_name"), F.col("item_no").alias("row_id"), F.col(field).alias("t"), F.lit(None).cast("string").alias("title")))
    return texts, items.select(F.col("vision_text").alias("t"))


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.Findings(*page_texts(spark, sf_dir)).defects()


@query
def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts in continuous paragraphs."""
    texts, readings = page_texts(spark, sf_dir)
    return scanned.Findings(texts, readings).repaired(texts.distinct()).select("field_name", "row_id", F.col("t").alias("text"))


@query
def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its container for each capacity."""
    sized = packing.token_counts(read(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))
    return packing.pack(sized, read(spark, sf_dir, "token_budgets")).withColumnRenamed("item_id", "doc_id")


def crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlaps(read(spark, sf_dir, "samples"), F.col("sample_no"), F.col("text_lines"), splits.split_name(F.col("split_name")))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossing(spark, sf_dir).select(F.least("train_record", "held_record").alias("sample_a"), F.greatest("train_record", "held_record").alias("sample_b")).distinct()


@query
def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps by the held-out sample's split and book."""
    coded = coded_samples(spark, sf_dir).select(F.col("sample_no").alias("held_record"), splits.key_of(F.get("codes", F.lit(0))).alias("book")).dropDuplicates(["held_record"])
    counts = overlap.overlap_counts(read(spark, sf_dir, "samples"), F.col("sample_no"), F.col("text_lines"), splits.split_name(F.col("split_name")))
    return counts.join(coded, "held_record", "left").groupBy("held_split", "book", "kind").agg(F.sum("n_pairs").alias("n_pairs"), F.countDistinct("held_record").alias("n_held"))
