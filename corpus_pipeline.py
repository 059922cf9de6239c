"""A corpus pipeline: each stage works on all that its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)``. Its result is written as Parquet in
the shared folder and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm import jaccard_join, packing, quality_classifier, quality_rules, substring_dedup
from tallymart.session import fresh_folder


def classifier(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality_classifier.classify(docs, labels)
    return judged.filter("quality_kept").select(*map(F.col, docs.columns))


def rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.judge(docs).filter("kept").select(*map(F.col, docs.columns))


def near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one of smallest doc_id, then row.

    Rows are the nodes, not ids: every row gets a key written with it before
    the join, so repeated rows of one id, rows of a null id and two texts of one
    id are each judged by their own text. A null id sorts last in its group.
    Rows without words link with nothing and all stay.
    """
    keyed_at = fresh_folder(spark, "pipeline-rows")
    docs.withColumn("_row", F.monotonically_increasing_id()).write.parquet(keyed_at)
    keyed = spark.read.parquet(keyed_at)
    groups = jaccard_join.join(keyed.select(F.col("_row").alias("doc_id"), "text")).select(
        F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")
    )
    placed = keyed.join(groups, "_row")
    first = placed.groupBy("_group").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("_row"))).alias("_first")
    )
    chosen = first.select(F.col("_first._row").alias("_row"))
    return keyed.join(chosen, "_row", "left_semi").select(*map(F.col, docs.columns))


def passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones have too."""
    kept = substring_dedup.dedup(docs)
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", length).select(*map(F.col, docs.columns))


def sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each piece of each document, and its place in the packed sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("copy")


STAGES = [
    ("quality_classifier", classifier),
    ("quality_rules", rules),
    ("jaccard_join", near_copies),
    ("substring_dedup", passages),
    ("packing", sequences),
]

# Models and packing cannot be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = fresh_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
