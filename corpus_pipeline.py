"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, benchmark decontamination, byte-level BPE."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from roadgrade.llm import bpe, decontaminate, lines, near, quality
from roadgrade.llm.common import cut, table
from roadgrade.llm.queries import ranks_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the model reject go. The model is fitted on the labelled documents of the stage's input."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first."""
    return lines.strip(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of five-word shingles 0.8 and more) the document of the least doc_id stays."""
    return near.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return bpe.digest(docs, ranks_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]
#: SQL can't express the fitted model, the hashes and the merges; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = _written(spark, docs)
    return docs


def _written(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs as Parquet in the shared checkpoint folder, read again."""
    import uuid

    base = spark.sparkContext.getCheckpointDir()
    if base is None:
        cut(spark.range(0))  # makes one, as in tests
        base = spark.sparkContext.getCheckpointDir()
    path = os.path.join(base, f"stage-{uuid.uuid4().hex}")
    docs.write.parquet(path)
    return spark.read.parquet(path)
