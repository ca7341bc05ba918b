"""Test items inside documents: MinHash containment search by size classes, verified on full shingle sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import few, keep

WIDTH = 5


def words(text: str | Column) -> Column:
    """Lower-cased words between white space (blank, tab to carriage return); none for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def shingles(text: str | Column, width: int = WIDTH) -> tuple[Column, Column]:
    """The words, and from them as column ``_w`` 64-bit hashes: of all runs of ``width`` words; of the whole sequence if it
    has fewer; none without words."""
    w = words(text)
    runs = F.transform(F.sequence(F.lit(1), F.size("_w") - (width - 1)), lambda i: F.xxhash64(*[F.element_at("_w", i + k) for k in range(width)]))
    whole = F.array(F.xxhash64(F.concat_ws(" ", "_w")))
    return w, F.when(F.size("_w") >= width, runs).when(F.size("_w") > 0, whole).otherwise(F.array().cast("array<bigint>"))


def shingle_rows(df: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """``id`` and ``h``: a row for each shingle of each text."""
    w, runs = shingles("_text", width)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).select("id", w.alias("_w")).select("id", F.explode(runs).alias("h"))


def item_sets(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``set_id`` (smallest item id), ``hs`` (sorted distinct shingles), ``n`` and ``copies`` of each different item."""
    w, runs = shingles("_text", width)
    rows = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("_text"))
    sets = rows.distinct().select("id", w.alias("_w")).select("id", F.array_sort(F.array_distinct(runs)).alias("hs")).filter(F.size("hs") > 0)
    return sets.groupBy("hs").agg(F.min("id").alias("set_id"), F.countDistinct("id").alias("copies")).withColumn("n", F.size("hs"))


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                    item_id: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """Pairs of a document and a test item with at least ``percent`` of the item's distinct shingles in the document.

    Columns ``id`` (the document's), ``set_id`` (smallest id of the items with that text), ``copies`` (how many), ``n`` and
    ``found`` (shingles of the item, and those in the document).

    Items are put into classes by set size. From the class's largest size follows how many minwise shingles (those of
    lowest hash) an item needs so that a document which holds enough of it must hold one of these: one more than may be
    missing. Documents are probed with these alone, at every shingle, so no length of a document can hide an item. The
    pairs met are then counted on the full sets.

    Null or empty texts hold nothing and are held by nothing; an item of fewer than ``width`` words is one shingle, held by
    documents of just these words. Rows with equal document ids count as one document, also those with a null id; items
    with null ids are passed over, and repeated ones count once. Shingles of items and ids of documents met are broadcast as
    long as they are ``session.FEW`` rows, so that no shingle of a document is shuffled; beyond that Spark chooses.
    """
    sets = keep(item_sets(items, item_id, item_text, width), "items")
    size_class = F.pow(2.0, F.ceil(F.log2("n"))).cast("int")
    missing = size_class - F.ceil(size_class * F.lit(percent) / 100).cast("int")
    probes = keep(sets.select("set_id", F.explode(F.slice("hs", 1, missing + 1)).alias("h")), "probes")
    met = keep(shingle_rows(docs, id_col, text_col, width).join(few(probes), "h").select("id", "set_id").distinct(), "met")
    near = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    near = near.join(few(met, met.select(F.col("id").alias("_id")).distinct()), F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    full = keep(sets.select("set_id", F.explode("hs").alias("h")), "shingles")
    held = shingle_rows(near, "id", "text", width).join(few(full), "h").groupBy("id", "set_id").agg(F.countDistinct("h").alias("found"))
    pairs = held.join(met.withColumnRenamed("id", "_id").withColumnRenamed("set_id", "_set"),
                      F.col("id").eqNullSafe(F.col("_id")) & (F.col("set_id") == F.col("_set")), "left_semi")
    return pairs.join(sets.select("set_id", "copies", "n"), "set_id").filter(F.col("found") * 100 >= F.col("n") * percent).select(
        "id", "set_id", "copies", "n", "found")


def contamination(docs: DataFrame, items: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """A row per document id: ``n_items`` held, ``first_item`` (smallest id, null if none), ``best_percent`` (rounded down
    share of the item's shingles found, 0 if none) and ``contaminated``."""
    held = contained_items(docs, items, percent, id_col, text_col, **names).groupBy("id").agg(
        F.sum("copies").alias("n_items"), F.min("set_id").alias("first_item"), F.max(F.floor(F.col("found") * 100 / F.col("n"))).alias("best_percent"))
    ids = docs.select(F.col(id_col).alias("doc")).distinct()
    return ids.join(held, F.col("doc").eqNullSafe(F.col("id")), "left").select(
        F.col("doc").alias(id_col), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"), "first_item",
        F.coalesce("best_percent", F.lit(0)).cast("bigint").alias("best_percent"), F.col("n_items").isNotNull().alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` whose document holds no test item; rows without an id are judged by their own text, each for
    itself. Columns stay as they are."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.struct(
        F.col(id_col).alias("i"), F.when(F.col(id_col).isNull(), F.sha2(text_col, 256)).alias("t")).alias("id"), F.col(text_col).alias("text"))
    bad = keep(contained_items(rows, items, percent, "id", "text", **names).select(F.col("id").alias("bad")).distinct(), "bad")
    return rows.join(few(bad), F.col("id") == F.col("bad"), "left_anti").select("row.*")
