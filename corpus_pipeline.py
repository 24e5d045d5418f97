"""A corpus from raw documents to token ids: rules, classifier, near-duplicates, mix, encoding. Part of ``sondeo.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondeo.llm import boosted_rules, mixing, piece_scan, trie_join, vote_classifier
from sondeo.llm.common import new_folder
from sondeo.llm.queries import PIECES


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the fixed rules and the trees, which are grown on labelled rows of the documents table."""
    forest = boosted_rules.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return boosted_rules.quality_rules(docs, forest, carry="row").where("kept").select("row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the vote calls good. The model is fitted on the documents table, as the rules before have taken most bad examples."""
    model = vote_classifier.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return vote_classifier.classify(docs, model, carry="row").where("predicted = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents, one row of the smallest id; repeated rows count as linked, so one of them stays. A row
    without an id is judged by its text: it stays if nothing links with it, or as one of a component that has no id at all."""
    return trie_join.representatives(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as many times as the mix takes them."""
    return mixing.repeated(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's ids, and whether they decode to its text. The ids are written and read back before they are decoded: in one stage,
    every core would keep a worker for each of the two functions."""
    path = new_folder(spark, "encoded")
    piece_scan.encode(docs, PIECES).write.parquet(path)
    found = piece_scan.round_trip(spark.read.parquet(path), PIECES)
    return found.select("doc_id", "ids", "n_tokens", "ids_crc32", (F.col("text_crc32") == F.col("source_crc32")).alias("exact"))


STAGES = [("quality rules", quality_rules), ("quality classifier", quality_classifier), ("n-gram Jaccard join", near_duplicates),
          ("mixing sources to target weights", source_mixing), ("SentencePiece encoding and decoding", encoding)]

#: Fitted models, hashed random numbers and piece segmentation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    path = new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
    return docs
