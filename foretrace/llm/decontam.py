"""Find benchmark items in training texts: n-gram seeds, then Smith-Waterman alignment.

Seeds are the word n-grams of the items. A document that has any seed of an item is aligned with the
item around it, so that edited, shortened and partly paraphrased copies score too, however many
other copies there are. An upper bound of the score, from the words that a passage shares with
the item, spares the alignments that cannot reach the share asked for; it loses none. Items
are handled in blocks of bounded size; texts are read once for a block and never shuffled.
"""

from __future__ import annotations

import functools
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretrace.llm.hashing import Spans, word_ngrams
from foretrace.llm.store import with_bytes

SEED_WORDS = 3
LEAST_SHARE = 0.4
BLOCK_BYTES = 16 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
_BLANK = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


@functools.lru_cache(maxsize=1)
def _spans() -> Spans:
    return Spans(0)


def plain(text: bytes) -> bytes:
    """Lower-cased words without ASCII punctuation, one blank between them."""
    return b" ".join(text.decode("utf-8", "replace").lower().encode().translate(_BLANK).split())


def word_hashes(joined: bytes) -> np.ndarray:
    return word_ngrams(_spans(), joined, 1)


def seeds_of(joined: bytes) -> np.ndarray:
    """Hashes of its n-grams of SEED_WORDS words; of all words if there are fewer."""
    return word_ngrams(_spans(), joined, SEED_WORDS)


def alignment(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman: the best local score of two word sequences and where it ends in the passage.

    A row of the table needs one prefix maximum for gaps along it, as a gap costs the same per word."""
    step = -GAP * np.arange(len(passage) + 1)
    row, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        reached = row + GAP
        reached[1:] = np.maximum(reached[1:], row[:-1] + np.where(passage == word, MATCH, MISMATCH))
        np.maximum(reached, 0, out=reached)
        row = np.maximum.accumulate(reached + step) - step
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def bound(known: np.ndarray) -> int:
    """No local score is larger, if ``known`` tells which passage words the item has: of the words
    that an alignment spans, each of these scores MATCH at most and each other one costs something."""
    total = np.cumsum(np.where(known, MATCH, max(MISMATCH, GAP)))
    return int((total - np.minimum.accumulate(np.minimum(total, 0))).max(initial=0)) if len(total) else 0


class Items:
    """A block of benchmark items with their seeds."""

    def __init__(self, ids: list, texts: list[bytes]):
        joined = [plain(t) for t in texts]
        known = [k for k, j in enumerate(joined) if j]
        self.ids = [ids[k] for k in known]
        self.words = [word_hashes(joined[k]) for k in known]
        self.sorted_words = [np.unique(w) for w in self.words]
        own = [seeds_of(joined[k]) for k in known]
        self.sizes = sorted({min(len(w), SEED_WORDS) for w in self.words})
        self.seed = np.concatenate([np.zeros(0, np.uint64), *own])
        self.item = np.repeat(np.arange(len(known)), [len(s) for s in own])
        self.place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(s)) for s in own]])
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.item, self.place = self.seed[order], self.item[order], self.place[order]

    def present(self, found: np.ndarray) -> np.ndarray:
        """Which of the hashes are seeds."""
        if not len(self.seed):
            return np.zeros(len(found), bool)
        return self.seed[np.minimum(np.searchsorted(self.seed, found), len(self.seed) - 1)] == found

    def hits(self, joined: bytes) -> list[tuple[int, int]]:
        """(place, hash) of the seeds in a plain text. Items shorter than a seed are seeds of their own length."""
        found = []
        n_words = joined.count(b" ") + 1 if joined else 0
        for size in self.sizes:
            if size <= n_words:
                grams = word_ngrams(_spans(), joined, size)
                found += [(int(p), grams[p]) for p in np.flatnonzero(self.present(grams))]
        return found

    def matches(self, text: bytes, least: float) -> list[tuple[int, int, float, int, int]]:
        """(item index, score, share of the best score possible, first word, end word) of each item
        of which the text holds ``least`` or more."""
        joined = plain(text)
        starts_of: dict[int, set[int]] = {}
        for p, h in self.hits(joined):
            for s in range(int(np.searchsorted(self.seed, h, "left")), int(np.searchsorted(self.seed, h, "right"))):
                starts_of.setdefault(int(self.item[s]), set()).add(p - int(self.place[s]))
        if not starts_of:
            return []
        words, out = word_hashes(joined), []
        for k, starts in sorted(starts_of.items()):
            item = self.words[k]
            reach = len(item) // 2 + 2
            passages: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(0, s - reach), min(len(words), s + len(item) + reach)
                if passages and a <= passages[-1][1]:
                    passages[-1][1] = max(passages[-1][1], b)
                else:
                    passages.append([a, b])
            own = self.sorted_words[k]
            passages = [(a, b) for a, b in passages if bound(own[np.minimum(np.searchsorted(own, words[a:b]), len(own) - 1)] == words[a:b]) / (MATCH * len(item)) >= least]
            if not passages:
                continue
            score, first, end = max((score, a, a + end) for a, b in passages for score, end in [alignment(item, words[a:b])])
            share = score / (MATCH * len(item))
            if share >= least:
                _, back = alignment(item[::-1], words[first:end][::-1])
                out.append((k, score, share, end - back, end))
        return out


def _blocks(items: DataFrame) -> Iterator[Items]:
    """The items in blocks of about BLOCK_BYTES of text, each small enough for every task."""
    plain_items = items.select("item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    total = plain_items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        rows = plain_items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"], bytes(r["text"])))
        yield Items([r["item_id"] for r in rows], [bytes(r["text"]) for r in rows])


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """doc_id, item_id, score, share, first_word, end_word for each document and each item of which
    it holds a copy: ``share`` is the alignment score over that of a full copy.

    Null and empty texts and items match nothing. Every row stands for itself: equal rows give
    equal results. Word numbers count words without ASCII punctuation."""
    out = None
    for block in _blocks(items):
        ready = docs.sparkSession.sparkContext.broadcast(block)

        def align(batches: Iterator[pd.DataFrame], ready=ready) -> Iterator[pd.DataFrame]:
            known = ready.value
            for batch in batches:
                rows = [(doc, known.ids[k], score, share, a, b) for doc, text in zip(batch["doc_id"], batch["text"])
                        for k, score, share, a, b in known.matches(text, least)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "share", "first_word", "end_word"]).astype(
                    {"doc_id": "Int64", "item_id": "Int64"})

        found = with_bytes(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id").mapInPandas(
            align, "doc_id long, item_id long, score long, share double, first_word long, end_word long")
        out = found if out is None else out.union(found)
    return out


def _holder(ready: Broadcast, least: float):
    @F.pandas_udf("boolean")
    def holds(text: pd.Series) -> pd.Series:
        return pd.Series([bool(ready.value.matches(t, least)) for t in text], dtype=bool)

    return holds


def clean(docs: DataFrame, items: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """The documents that hold no copy of an item; all columns stay."""
    out = docs
    for block in _blocks(items):
        ready = docs.sparkSession.sparkContext.broadcast(block)
        out = out.filter(~_holder(ready, least)(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return out
