"""From raw documents to packed training sequences, stage by stage.

Each stage takes the documents that its predecessor kept, as written, and its decisions take
effect: rejected documents go, repeated lines go, of each group of near copies one document stays,
documents with benchmark passages go, and the rest is packed. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.llm import decontam, lines, near, packing, quality
from foretrace.llm.queries import tokenizer
from foretrace.llm.store import shared_folder, ship, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the simple rules and lie in their language's perplexity band."""
    return quality.judged(docs).filter("__kept__").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each group of similar lines is kept once. Documents of which nothing is left go; n_chars
    follows the text. A document that had no words from the start stays as it is."""
    word = r"[^\x20\x09-\x0D]"
    had = docs.withColumn("__had__", F.coalesce(F.col("text").rlike(word), F.lit(False)))
    out = lines.deduplicated(had).filter(~F.col("__had__") | F.col("text").rlike(word))
    return out.select(*[F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8."""
    return near.one_of_each(docs, n=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.packed_documents(docs, tokenizer())


def _shipped(stage):
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality rules", _shipped(quality_rules)),
    ("line dedup", _shipped(line_dedup)),
    ("near dedup", _shipped(near_dedup)),
    ("decontamination", _shipped(benchmark_decontamination)),
    ("packing", _shipped(best_fit_packing)),
]

# Tokens, perplexities and signatures are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
