"""The corpus pipeline: quality classifier, language, near copies, packing; each stage works on what the one before kept."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm import queries as Q
from veilmark.llm import shingle_join
from veilmark.plans.session import shared_folder

# SQL cannot express training, compression or tokenizers; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels, selects."""
    return Q.quality(spark, docs, sf_dir).where("selected").select(*Q.restored(docs, "extracted_text"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter or with a narrow margin go."""
    return Q.languages(docs).where("NOT narrow").select(*Q.restored(docs, "composite"))


def one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id. Rows without an id stay."""
    groups = shingle_join.similar_frames(Q.frame_texts(docs))
    copies = groups.where("component_id < frame_idx").select(F.col("frame_idx").alias("doc_id")).distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of at most 1024 ids."""
    return Q.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("language", known_language),
    ("near copies", one_of_a_kind),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/stage-{k}")
        docs = spark.read.parquet(f"{folder}/stage-{k}")
    return docs
