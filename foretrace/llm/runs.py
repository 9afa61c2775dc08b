"""Periodic runs of words, found with a dictionary of basic factors.

A basic factor is a stretch of 2**k words. For each k, every repeated factor gets a name (a pair of
names of half its length), and each occurrence its successor: the next place of the same name. Where
successors within twice the factor's length keep one distance over consecutive places, occurrences
form arithmetic progressions and the distance is proposed as a period. Proposals are extended as far
as the words keep the period; what several lengths propose is kept once. Factors that occur once
are dropped before the next length, so ordinary prose ends after a few lengths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foretrace.llm.store import with_bytes

# Words that one pass names together: many short documents, or one long one.
WORDS_AT_ONCE = 200_000
SCHEMA = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class _Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def word_numbers(documents: list[list[bytes]]) -> np.ndarray:
    """One number per word, all documents in a row; equal only for equal words of one document, so
    that no repeat reaches across documents."""
    numbers = _Numbers()
    flat = np.fromiter((n for words in documents for n in map(numbers.__getitem__, words)), np.int64, sum(map(len, documents)))
    return flat + np.repeat(np.arange(len(documents)) * len(numbers), [len(words) for words in documents])


def _extended(words: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
    """Move the ends of each stretch outward, in place, while the words keep its period."""
    open_ = np.arange(len(start))
    while len(open_ := open_[start[open_] > 0]):
        open_ = open_[words[start[open_] - 1] == words[start[open_] - 1 + period[open_]]]
        start[open_] -= 1
    open_ = np.arange(len(start))
    while len(open_ := open_[end[open_] < len(words)]):
        open_ = open_[words[end[open_]] == words[end[open_] - period[open_]]]
        end[open_] += 1


def periodic_runs(words: np.ndarray, at_least: int = 6, times: int = 4) -> np.ndarray:
    """Rows (start, length, period), by start and period, of all maximal stretches of ``words``
    whose smallest period q gives a length of at least ``at_least`` and ``times`` * q.

    ``times`` must be 4 or more. A factor at least as long as q, and shorter than 2q, then has a
    successor at exactly q from q + 1 places of such a run, so that every run is proposed."""
    if times < 4:
        raise ValueError("progressions prove runs of four periods or more")
    n, width, found = len(words), 1, []
    at, key = np.arange(n), words
    while len(at):
        order = np.argsort(key, kind="stable")
        place, same = at[order], key[order][1:] == key[order][:-1]
        gap = np.diff(place)
        near = same & (gap <= 2 * width)
        successor = np.zeros(n, np.int64)
        successor[place[:-1][near]] = gap[near]
        i = np.flatnonzero(successor)
        if len(i):
            d = successor[i]
            first = np.flatnonzero(np.r_[True, (np.diff(i) != 1) | (np.diff(d) != 0)])
            period, start = d[first], i[first]
            end = start + np.diff(np.r_[first, len(i)]) + width + period - 1
            # A difference of at most the factor's length is the smallest period there.
            good = (period <= width) & (end - start >= np.maximum(at_least, times * period))
            start, end, period = start[good], end[good], period[good]
            _extended(words, start, end, period)
            found.append(np.stack([start, end - start, period], axis=1))
        group = np.cumsum(np.r_[True, ~same])
        again = np.bincount(group)[group] > 1
        name = np.zeros(n, np.int64)
        name[place[again]] = group[again]
        at = np.flatnonzero(name[: max(0, n - width)])
        at = at[name[at + width] > 0]
        key = name[at] * (len(group) + 1) + name[at + width]
        width *= 2
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = np.unique(rows, axis=0) if len(rows) else rows
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by blanks."""
    if not len(runs):
        return b" ".join(words)
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, runs[:, 0] + runs[:, 2], 1)
    np.add.at(inside, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(inside)[:-1] == 0)])


def runs_collapsed(docs: DataFrame, id: str = "doc_id", text: str = "text", at_least: int = 6, times: int = 4,
                   rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per row of ``docs``: its id, n_words, its runs by start and period, and the text with every
    run collapsed to its first period (words joined by one blank).

    Words are runs of characters other than 0x20 and 0x09-0x0D of the whole text. ``rewrite`` may
    give other words for a row, from its id and words. Nothing is shuffled: a document's runs need
    its own words only. A null, empty or blank text has no words, no runs and an empty collapsed
    text; a null id is kept; repeated rows give repeated results; runs that overlap are all
    returned; an empty table gives an empty one; other columns of ``docs``, whatever their names,
    are left out."""

    def rows(ids: list, documents: list[list[bytes]]) -> pa.RecordBatch:
        found = periodic_runs(word_numbers(documents), at_least, times)
        ends = np.cumsum([len(words) for words in documents])
        cuts = np.r_[0, np.searchsorted(found[:, 0], ends)]
        runs, collapsed = [], []
        for k, words in enumerate(documents):
            own = found[cuts[k] : cuts[k + 1]] - [ends[k] - len(words), 0, 0]
            runs.append([{"start": a, "length": b, "period": c} for a, b, c in own.tolist()])
            collapsed.append(_collapsed(words, own).decode("utf-8", "replace"))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(w) for w in documents], pa.int64()), pa.array(runs, _RUNS), pa.array(collapsed, pa.string())],
            names=[id, "n_words", "runs", "collapsed"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            documents, size, begun = [], 0, 0
            for k, (key, data) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                words = data.as_py().split()
                documents.append(rewrite(key, words) if rewrite else words)
                size += len(words)
                if size >= WORDS_AT_ONCE:
                    yield rows(batch.column(0).slice(begun, len(documents)), documents)
                    documents, size, begun = [], 0, k + 1
            if documents:
                yield rows(batch.column(0).slice(begun, len(documents)), documents)

    kind = docs.schema[id].dataType.simpleString()
    return with_bytes(docs, id, text=text).mapInArrow(found, f"`{id}` {kind}, {SCHEMA}")
