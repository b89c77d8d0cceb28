"""Documents to clean, distinct, uncontaminated, tokenised documents, stage by stage; every stage is written and read again."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.llm import decontaminate, exact_dedup, near_dedup, pieces, quality
from logstrata.session import checkpoint_dir, use_utc


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier rejects go."""
    return quality.drop_poor(docs)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the one with the least doc_id stays."""
    return near_dedup.keep_one_of_each_group(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their pieces, and whether the pieces decode to the text (the mark U+2581 reads as a blank)."""
    coded = pieces.encode(docs, and_decode=True)
    same = F.translate(F.coalesce("text", F.lit("")), pieces.MARK, " ") == F.col("decoded")
    return coded.select(*docs.columns, F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", same.alias("round_trip"))


STAGES = [
    ("quality_classifier", keep_good), ("exact_dedup", keep_distinct), ("near_dedup", keep_one_of_each_group),
    ("decontamination", keep_uncontaminated), ("piece_codec", encode),
]

#: The first stage's decisions come from a trained model and the last one's rows from a vocabulary file, which SQL cannot express;
#: tests/llm/test_pipeline.py compares the pipeline with a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on sf_dir's documents. Each stage's rows go to the shared folder as Parquet, and the next stage reads them there."""
    use_utc(spark)
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
