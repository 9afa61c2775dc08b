"""Remove passages of ``window`` words that an earlier document has too.

Method: a count-min prefilter. Each task adds the windows it reads to a sketch; the merged
sketches overestimate how many documents hold a window; a second pass groups exactly the
windows that may be repeated, losing none.

Every window is counted through its anchor, the smallest hash among its runs of half its
words. The anchor depends on the window's words alone, so equal windows share it and its count
is at least theirs, and neighbouring windows mostly share it too: the sketch takes about a
thirteenth of the entries that the windows themselves would need.

Windows of which one task reads several are settled there: all but the one in its smallest
document are repeated. So at most one row of a window leaves each task, however many
documents hold it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretrace.llm.hashing import sequence_hashes, sliding_min, word_hashes
from foretrace.llm.sketches import Bits, cell_bits, count_min
from foretrace.llm.store import with_bytes

WINDOW = 50
FLUSH = 1_000_000
_LAST = (1 << 63) - 1


def _anchors(words: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each window of a text with at least ``window`` words, from their hashes."""
    half = max(1, window // 2)
    return sliding_min(sequence_hashes(words, half), window - half + 1)


def expected_anchors(text_bytes: int, window: int) -> float:
    return text_bytes / 6 * 2 / max(2, window - window // 2 + 2)


def sketch(docs: DataFrame, window: int, bits: int) -> Bits:
    """Which anchors two or more documents may hold."""

    def anchors(batch: pd.DataFrame) -> Iterator[np.ndarray]:
        for text in batch["text"]:
            if len(words := text.split()) >= window:
                yield np.unique(_anchors(word_hashes(words)[:, 0], window))

    return count_min(with_bytes(docs), anchors, bits, flush=FLUSH)


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """_doc, _crc, starts: for each document that has any, the first words of its windows whose
    word sequence also stands in a document with a smaller id.

    Windows are told apart by 96 bits of two independent hashes of their words' hashes. _doc is the
    doc_id, a missing one counting as larger than any; _crc tells apart different texts of one
    doc_id. Equal windows of one doc_id never make each other repeated. Null texts have none."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shared = spark.sparkContext.broadcast(sketch(docs, window, cell_bits(expected_anchors(total, window))))

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def flush() -> pd.DataFrame:
            one, two, doc, crc, at = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((at, crc, doc, two, one))
            one, two, doc, crc, at = one[order], two[order], doc[order], crc[order], at[order]
            new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
            smallest = doc[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            settled = doc > smallest
            # Of rows with the smallest id, those after the first have to wait for the others too.
            return pd.DataFrame({"one": one.view(np.int64), "two": two.view(np.int32), "_doc": doc,
                                 "at": (crc << 32 | at).view(np.int64), "settled": settled})

        size = 0
        for batch in batches:
            for doc, text in zip(batch["_doc"], batch["text"]):
                if len(words := text.split()) < window:
                    continue
                own = word_hashes(words)
                at = np.flatnonzero(shared.value.hit(_anchors(own[:, 0], window)))
                if len(at):
                    one, two = sequence_hashes(own[:, 0], window)[at], sequence_hashes(own[:, 1], window, 1)[at]
                    held.append((one, two.astype(np.uint32),
                                 np.full(len(at), doc, np.int64), np.full(len(at), zlib.crc32(text), np.int64), at))
                    size += len(at)
                    if size >= FLUSH:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    found = with_bytes(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_doc"), "text"), "_doc").mapInPandas(
        candidates, "one long, two int, _doc long, at long, settled boolean")
    # A settled row goes along without a partner: its key is its own place.
    alone = F.when(F.col("settled"), F.xxhash64("_doc", "at")).otherwise(F.col("one"))
    same = Window.partitionBy("one", "two", "settled")
    repeated = found.withColumn("one", alone).withColumn("_smallest", F.min("_doc").over(same)).filter(
        F.col("settled") | (F.col("_doc") > F.col("_smallest")))
    return repeated.groupBy("_doc", F.shiftrightunsigned("at", 32).alias("_crc")).agg(
        F.collect_list(F.col("at").bitwiseAND((1 << 32) - 1).cast("int")).alias("starts"))


def covered(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a window that begins at one of the starts."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def deduplicated(docs: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, kept_text (kept words with
    one blank between them) and spans (removed word ranges, ends excluded) of every document.

    Documents shorter than the window, empty and null ones lose nothing; a null text counts
    as empty. Other columns of ``docs`` are left out."""

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (
        ", kept_text string, spans array<struct<start: int, end: int>>" if texts else "")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text", "spans"] if texts else [])]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, starts in zip(batch["doc_id"], batch["text"], batch["starts"]):
                words, spans, removed = text.split(), [], 0
                if starts is not None:
                    gone = covered(len(words), np.asarray(starts, np.int64), window)
                    flips = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                    spans = [(int(a), int(b)) for a, b in zip(flips[::2], flips[1::2])]
                    removed = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                kept = b" ".join(words)
                rows.append((doc, len(words) + removed, removed, hashlib.sha256(kept).hexdigest(), *((kept.decode("utf-8", "replace"), spans) if texts else ())))
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    plain = with_bytes(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id").withColumn(
        "_doc", F.coalesce("doc_id", F.lit(_LAST))).withColumn("_crc", F.crc32("text"))
    return plain.join(repeated_windows(docs, window), ["_doc", "_crc"], "left").select("doc_id", "text", "starts").mapInPandas(
        cut, schema)
