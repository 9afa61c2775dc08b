"""Token counts: an exact histogram of encoded lengths and what its suffix sums answer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretrace.llm.store import keep, with_bytes
from foretrace.llm.tokens import word_ids

BAND = 1024


def encoded_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """n_tokens of each document's whole text, without special ids; null and empty texts have 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = word_ids(tokenizer)
        for batch in batches:
            yield pd.DataFrame({"n_tokens": [len(coder.ids(t)) // 4 for t in batch["text"]]}, dtype="int64")
        coder.forget()

    return with_bytes(docs).mapInPandas(count, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """n_docs for each n_tokens; rows meet already added up within their tasks. Written once: reports
    read it more than once, and the texts would be encoded as often."""
    return keep(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))


def length_report(hist: DataFrame, band: int = BAND) -> DataFrame:
    """For each length that occurs, taken as a context limit:

    docs_over, tokens_over: documents longer than the limit and their tokens (suffix sums)
    docs_within: documents that fit whole; share_within: their share, which makes the
        smallest limit with share_within >= q the exact q-quantile of the lengths
    truncated_tokens: tokens kept when every document is cut at the limit
    lost_tokens: tokens cut off

    Sums run inside bands of ``band`` lengths and over the totals of the bands, so no task
    holds more than ``band`` lengths. No documents give no rows."""
    banded = hist.withColumn("_band", F.floor(F.col("n_tokens") / band))
    totals = banded.groupBy("_band").agg(F.sum("n_docs").alias("_d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("_t"))
    above = Window.orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    totals = totals.select(
        "_band", F.coalesce(F.sum("_d").over(above), F.lit(0)).alias("_d_above"),
        F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_t_above"),
        F.sum("_d").over(everything).alias("total_docs"), F.sum("_t").over(everything).alias("total_tokens"))
    longer = Window.partitionBy("_band").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda x, base: F.coalesce(F.sum(x).over(longer), F.lit(0)) + F.col(base)
    limit = F.col("n_tokens")
    return (
        banded.join(totals, "_band")
        .withColumn("docs_over", over(F.col("n_docs"), "_d_above"))
        .withColumn("tokens_over", over(F.col("n_docs") * limit, "_t_above"))
        .withColumn("docs_within", F.col("total_docs") - F.col("docs_over"))
        .withColumn("truncated_tokens", F.col("total_tokens") - F.col("tokens_over") + limit * F.col("docs_over"))
        .select("n_tokens", "n_docs", "docs_within", "docs_over", "tokens_over", "truncated_tokens",
                (F.col("total_tokens") - F.col("truncated_tokens")).alias("lost_tokens"),
                "total_docs", "total_tokens", (F.col("docs_within") / F.col("total_docs")).alias("share_within")))


def context_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """The same sums for stated limits, whether or not a document has that length."""
    spark = hist.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    n, limit = F.col("n_tokens"), F.col("context_limit")
    each = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])) if limits else F.lit(None).cast("long")
    sums = hist.withColumn("context_limit", each).groupBy("context_limit").agg(
        F.sum(F.when(n > limit, F.col("n_docs")).otherwise(0)).alias("docs_over"),
        F.sum(F.col("n_docs")).alias("total_docs"), F.sum(F.col("n_docs") * n).alias("total_tokens"),
        F.sum(F.col("n_docs") * F.least(n, limit)).alias("truncated_tokens"))
    return asked.join(sums, "context_limit", "left")


def quantiles(report: DataFrame, shares: list[float]) -> DataFrame:
    """The exact quantiles: for each share, the smallest length that so many documents do not exceed."""
    picks = [F.min(F.when(F.col("share_within") >= float(q), F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(shares)]
    row = report.agg(*picks)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, q in enumerate(shares)])).alias("x")).select("x.*")
