"""Registered queries of the operators of this package over the test tables, with production settings."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import state_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op3_byte_bpe")
def byte_bpe(spark, d):
    import public_tokenizers

    from .byte_bpe import byte_bpe_digest

    return byte_bpe_digest(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op4_token_counts")
def token_counts(spark, d):
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op7_token_files")
def token_files(spark, d):
    import public_tokenizers

    from .token_files import read_token_files, write_token_files

    folder = f"{state_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, d, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, folder, digest=True)


@query("op8_quality")
def quality(spark, d):
    from .quality import scored

    return scored(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op9_main_text")
def main_text(spark, d):
    from .html_main import extract_main_text

    return extract_main_text(table(spark, d, "pages"))


@query("op5_hash_forest")
def hash_forest(spark, d):
    from .hash_forest import nearest

    rows = table(spark, d, "embeddings")
    return nearest(rows, rows.filter("vec_id % 20 = 0")).selectExpr("query_id", "rank", "vec_id", "score")


@query("op10_decontamination", """
WITH w AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' ')) END) AS s FROM w),
bs AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' ')) END) AS s FROM i),
n AS (SELECT id, count(*) AS n FROM bs GROUP BY id),
held AS (SELECT ds.id AS doc_id, bs.id AS item_id, count(*) AS found FROM ds JOIN bs USING (s) GROUP BY ds.id, bs.id),
full_hits AS (SELECT doc_id, item_id, found, n FROM held JOIN n ON n.id = held.item_id WHERE found * 100 >= n * 80)
SELECT d.doc_id, count(item_id) AS n_items, min(item_id) AS first_item, coalesce(max(found * 100 // n), 0) AS best_percent,
  count(item_id) > 0 AS contaminated
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN full_hits h ON h.doc_id = d.doc_id GROUP BY d.doc_id""")
def decontamination(spark, d):
    from .decontaminate import contamination

    return contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op1_near_dedup")
def near_dedup(spark, d):
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, d, "documents"))


@query("op6_line_dedup")
def line_dedup(spark, d):
    from pyspark.sql import functions as F

    from .line_dedup import without_repeated_lines

    docs = table(spark, d, "documents")
    lines = F.size(F.split("text", "\n", -1)).cast("bigint")
    return without_repeated_lines(docs.select("doc_id", "text")).select(
        "doc_id", "lines_removed", F.when(F.col("text").isNull(), 0).otherwise(lines).alias("lines_left"), F.sha2("text", 256).alias("text_sha256"))


@query("op2_suffix_dedup")
def suffix_dedup(spark, d):
    from .suffix_dedup import without_repeats

    return without_repeats(table(spark, d, "documents"), digest=True)


@query("op11_merge_automaton")
def merge_automaton(spark, d):
    import public_tokenizers

    from .merge_automaton import automaton_bpe_digest

    return automaton_bpe_digest(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op13_hard_negatives", """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
  CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""")
def hard_negatives(spark, d):
    from pyspark.sql import functions as F

    from .hard_negatives import hard_negatives

    rows = table(spark, d, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


@query("op12_whitening")
def whitening(spark, d):
    from .whitening import whiten

    return whiten(table(spark, d, "embeddings"))
