"""From raw documents to token ids: quality, repeated lines, near-copies, test items, encoding.

Every stage takes (spark, docs, folder of the tables) and returns a DataFrame; ``run`` writes each as Parquet in the shared
folder and reads it again for the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm import byte_bpe, decontaminate, line_dedup, near_dedup, quality
from wayloom.session import state_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the line model finds good. It is fitted on labelled documents that are not held out; documents
    without an id are judged as well."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    row = F.struct(*COLUMNS)
    scores = quality.quality_scores(docs.select(row.alias("row"), "text", F.col("doc_id")), model, id_col="row")
    return scores.filter("predicted = 1").select("row.*")


def first_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without lines that an earlier line of any document nearly equals; ``n_chars`` follows the text. Documents
    that are left without a word, copies all through, go."""
    left = line_dedup.without_repeated_lines(docs)
    left = left.filter((F.col("lines_removed") == 0) | F.col("text").rlike(r"\S"))
    return left.withColumn(
        "n_chars", F.when(F.col("lines_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def first_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-copies: five-word shingles, a similarity of 0.80 or more."""
    return near_dedup.without_near_duplicates(docs, percent=80, trees=6).select(*COLUMNS)


def clean_of_tests(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and ``decoded`` (text from the ids) of each document."""
    import public_tokenizers

    got = byte_bpe.byte_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return got.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("decoded"))


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", first_lines),
    ("MinHash near-dedup", first_copies),
    ("benchmark decontamination", clean_of_tests),
    ("byte-level BPE", token_ids),
]
#: The fitted line model cannot be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    folder = f"{state_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
