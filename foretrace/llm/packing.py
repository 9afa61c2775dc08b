"""Pack documents into training sequences by the sum-of-squares rule.

A piece goes where the sum of squared counts of open sequences, counted per residual gap,
becomes smallest: into an open sequence, or into a new one. Pieces are dealt by hash into
groups of bounded expected size, each packed by one task from (id, length) rows alone; no
text or token leaves the task that encoded it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretrace.llm.store import keep, with_bytes
from foretrace.llm.tokens import word_ids

SEQUENCE_TOKENS = 2048
GROUP_PIECES = 131_072
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoded_pieces(docs: DataFrame, tokenizer: str, sequence_tokens: int = SEQUENCE_TOKENS, end_id: int = 0,
                   with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``sequence_tokens`` ids of each document's whole text.

    A null or empty text has the end id only. Rows are independent of each other, so equal
    rows, equal ids and a null doc_id give their own pieces. ``with_ids`` adds the ids
    (binary, four little-endian bytes each). Other columns of ``docs`` are left out."""
    end = int(end_id).to_bytes(4, "little")
    step = 4 * sequence_tokens

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = word_ids(tokenizer)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = coder.ids(text) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    piece = ids[at : at + step]
                    rows.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece), *([piece] if with_ids else ())))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else ())])
            yield out.astype({"doc_id": "Int64"})
        coder.forget()

    plain = with_bytes(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id")
    return plain.mapInPandas(encode, PIECES + (", ids binary" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places pieces in the order given: (sequence, offset) of each, and how many sequences.

    With n[g] open sequences of gap g, moving one from gap h to h - s changes the sum of
    squares by 2 (n[h - s] - n[h] + 1), filling it by 1 - 2 n[h], opening one by
    2 n[capacity - s] + 1. Ties go to the smallest gap; a new sequence only if strictly better."""
    n = np.zeros(capacity, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity)]
    sequence, offset, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        if s >= capacity:
            sequence[i], used = used, used + 1
            continue
        here = n[s:]
        change = 2 * (n[: capacity - s] - here) + 2
        change[0] = 1 - 2 * here[0]
        change[here == 0] = 1 << 60
        left = int(change.argmin())
        if change[left] <= 2 * n[capacity - s] + 1:
            gap = left + s
            at = open_at[gap].pop()
            n[gap] -= 1
        else:
            at, gap, left, used = used, capacity, capacity - s, used + 1
        sequence[i], offset[i] = at, capacity - gap
        if left:
            n[left] += 1
            open_at[left].append(at)
    return sequence, offset, used


def _orders(lengths: np.ndarray, capacity: int) -> Iterator[np.ndarray]:
    """Long pieces first; or long ones first, then the middle as it came, then the shortest."""
    down = np.argsort(-lengths, kind="stable")
    yield down
    size = lengths[down]
    small = size <= capacity // 8
    half = (size <= capacity // 2) & ~small
    yield np.concatenate([down[~half & ~small], np.sort(down[half]), down[small]])
    yield np.concatenate([np.sort(down[~small]), down[small]])


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The best of a few orders of the same pieces."""
    best, least = None, -(-int(lengths.sum()) // capacity)
    for order in _orders(lengths, capacity):
        sequence, offset, used = sum_of_squares(lengths[order], capacity)
        if best is None or used < best[2]:
            best = (sequence, offset, used, order)
        if best[2] == least:
            break
    sequence, offset, _, order = best
    out = np.empty_like(sequence), np.empty_like(offset)
    out[0][order], out[1][order] = sequence, offset
    return out


def pack(pieces: DataFrame, sequence_tokens: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``sequence_tokens``.

    The number of groups follows the number of pieces, so a task holds about ``group_pieces``
    rows at any scale. The hash covers piece and checksum, not only the document, so a very
    long document or many copies spread over all groups. An empty table stays empty."""
    pieces = keep(pieces)
    groups = max(1, -(-pieces.count() // group_pieces))
    columns = pieces.columns

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_mix", "doc_id", "piece"], kind="stable", ignore_index=True)
        at, offset = place(rows["length"].to_numpy(np.int64), sequence_tokens)
        return rows[columns].assign(sequence_id=(int(key[0]) << 32) + at, offset=offset)

    mixed = pieces.withColumn("_mix", F.xxhash64("doc_id", "piece", "ids_crc32"))
    schema = f"{PIECES}, sequence_id long, offset long"
    return mixed.withColumn("_group", F.pmod("_mix", F.lit(groups))).groupBy("_group").applyInPandas(
        packed, schema if "ids" not in columns else f"{PIECES}, ids binary, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer: str, sequence_tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """Every piece of every document and its place."""
    return pack(encoded_pieces(docs, tokenizer, sequence_tokens), sequence_tokens)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids: the token ids of each sequence; wants pieces ``with_ids``.
    A group holds one sequence, whose size is bounded."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
