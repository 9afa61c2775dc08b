"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.llm import decontam, html, lengths, lines, near, packing, pii, quality, runs, shards, spelling, substrings, trie
from foretrace.llm.store import ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return build

    return wrap


def tokenizer(file: str = "word_bpe_49k.json") -> str:
    """The vocabulary file; it belongs to an installed package, so every machine has it."""
    import public_tokenizers

    return public_tokenizers.path(file)


@query("op1_sum_of_squares_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer())


@query("op2_maximum_scoring_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


@query("op3_count_min_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents"), window=50, texts=False)


@query("op4_fuzzy_line_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"), percent=80)


@query("op5_kneser_ney_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.judged(docs, drop=("text",)).select(
        "doc_id", "lang", "__q__.n_words", "__q__.word_chars", "__q__.n_symbols", "__q__.n_dup_lines", "__q__.n_repeat_words",
        F.col("__failed__").alias("base_failed"), F.col("__kept__").alias("kept"), "__q__.log_perplexity")


@query("op6_b_bit_minhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


@query("op7_feistel_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.sharded_documents(table(spark, sf_dir, "documents"), shards=16, seed=7)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "row_number")


@query("op8_surrogate_entities")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.anonymised(docs, key="op8").select("doc_id", F.col("__entities__").alias("n_entities"), "text")


@query("op9_aligned_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_token_length_histogram")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = lengths.encoded_lengths(table(spark, sf_dir, "documents"), tokenizer())
    return lengths.length_report(lengths.histogram(counted))


def _with_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten has its end rewritten to repeat a period; rows without an id do not."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query("op11_basic_factor_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.runs_collapsed(table(spark, sf_dir, "documents"), at_least=6, times=4, rewrite=_with_period)
    # The runs come by start and period: of equal exponents the first stays.
    best = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda a, b: F.when(
        a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(F.transform(line, lambda r: F.concat(r, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256", "n_words")


@query("op12_prefix_trie_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = trie.encoded(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), with_decoded=True)
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


@query("op13_reduced_alphabet_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), rewrite=spelling.one_dropped(97), at_least=3, letters=5, times=2)
