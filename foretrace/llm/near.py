"""Near-duplicate documents by b-bit MinHash.

Each document's word shingles give minima under 128 permutations. Bands of full minima generate
candidates; the two low bits of every minimum, packed, estimate similarity by counting equal lanes
with a correction for lanes equal by chance; links are confirmed on the full sets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.llm.hashing import MinHash, band_keys, mixed, packed_bits, shingle_hashes
from foretrace.llm.links import similar_components
from foretrace.llm.sketches import Bits
from foretrace.llm.store import keep, with_bytes

PERMUTATIONS = 128
BITS = 2
BANDS, ROWS = 25, 5  # at a similarity of 0.85 a pair misses all bands once in 2 million, at 0.8 once in 20,000
FLOOR = 0.2  # unrelated documents are rated about 0 with a standard error of 0.05
_NO_ID = 1 << 62


@functools.lru_cache(maxsize=1)
def _permutations() -> MinHash:
    return MinHash(PERMUTATIONS)


def shingles(text: bytes, n: int) -> np.ndarray:
    """Distinct hashes of the n-word shingles of a text with A-Z lower-cased; one hash of the
    whole sequence if it has fewer words; none without words."""
    return np.unique(shingle_hashes(text.lower(), n))


def _own_id() -> Column:
    """The doc_id; documents without one get a large number made from their text."""
    made = F.lit(_NO_ID) + F.xxhash64("text").bitwiseAND((1 << 61) - 1)
    return F.coalesce(F.col("doc_id").cast("long"), made)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """id, n_shingles, s1, s2 (a 128-bit sum that equal sets share), keys, sig of each document."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"], batch["text"]):
                own = shingles(text, n)
                if len(own):
                    low = _permutations().minima(own)
                    s1, s2 = (int(mixed(own ^ np.uint64(c)).sum(dtype=np.uint64).view(np.int64)) for c in (17, 1 << 40))
                    rows.append((doc, len(own), s1, s2, band_keys(low, BANDS, ROWS), packed_bits(low, BITS)))
                else:
                    rows.append((doc, 0, 0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)))
            yield pd.DataFrame(rows, columns=["id", "n_shingles", "s1", "s2", "keys", "sig"])

    return with_bytes(docs.select(_own_id().alias("id"), "text"), "id").mapInPandas(
        sign, "id long, n_shingles long, s1 long, s2 long, keys array<long>, sig array<long>")


def _texts(docs: DataFrame, wanted: Bits) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[shared.value.hit(batch["id"].to_numpy(np.int64))]

    return with_bytes(docs.select(_own_id().alias("id"), "text"), "id").mapInPandas(pick, "id long, text binary")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, ids_are_own: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Documents are linked if 100 * intersection >= percent * union of their sets of n-word
    shingles; component_id is the smallest doc_id that links reach. Documents with equal sets
    are one item from the start. Null and empty texts have an empty set and no links. Rows with
    one doc_id are one document. A document without doc_id is linked like any other, gives no
    component its name unless all of its documents lack one (then null), and is kept only then. ``ids_are_own``: report the numbers that
    such documents were given."""
    signed = keep(signatures(docs, n))
    held = signed.filter("n_shingles > 0")
    groups = keep(held.groupBy("s1", "s2", "n_shingles").agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("sig").alias("sig")))
    words = PERMUTATIONS * BITS // 64
    known = similar_components(groups.select("id", "keys", "sig"), words, BITS, FLOOR,
                               lambda wanted: _texts(docs, wanted), lambda text: shingles(text, n), percent)
    of_group = groups.select("s1", "s2", "n_shingles", "id").join(known, "id", "left").select(
        "s1", "s2", "n_shingles", F.coalesce("component", "id").alias("component"))
    named = signed.select("id", "n_shingles", "s1", "s2").join(of_group, ["s1", "s2", "n_shingles"], "left").withColumn(
        "component", F.coalesce("component", "id"))
    real = lambda c: F.when(F.lit(ids_are_own) | (F.col(c) < _NO_ID), F.col(c))
    return named.select(real("id").alias("doc_id"), "n_shingles", real("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without all but the first document, by doc_id, of each group; of equal rows one stays.

    Documents without words are in no group and all stay."""
    marks = docs.withColumn("__id__", _own_id()).withColumn("__hash__", F.xxhash64("text"))
    found = near_duplicates(docs.select(_own_id().alias("doc_id"), "text"), n, percent, ids_are_own=True)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("__id__")).distinct()
    stays = marks.join(gone, "__id__", "left_anti")
    word = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    unique = stays.withColumn("__key__", F.when(word, F.lit(0)).otherwise(F.monotonically_increasing_id()))
    return unique.dropDuplicates(["__id__", "__hash__", "__key__"]).select(*docs.columns)
