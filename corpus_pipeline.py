"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.decontamination import without_contaminated
from creditloom.llm.packing import packed
from creditloom.llm.parity_join import one_of_each_group
from creditloom.llm.suffix_dedup import deduplicated
from creditloom.llm.toxicity import fit_toxicity, without_toxic
from creditloom.sources.intermediate import materialise


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the score calls toxic; a fifth of the labels stays unseen, for measuring."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    seen = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return without_toxic(docs, fit_toxicity(docs, seen))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that shares four fifths of its runs of five words."""
    return one_of_each_group(docs, width=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 50 bytes and more that an earlier document holds."""
    return deduplicated(docs, length=50)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a benchmark item in them, up to a tenth of it edited."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=10)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of 2048 token ids."""
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("sequences", sequences),
]

# Learned scores, sketches, suffixes and packing have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
