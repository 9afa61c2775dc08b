"""Byte-pair encoding by a trie that shares the work of common prefixes, and decoding.

The encoding of a prefix followed by a token is the encoding of the longer text exactly if the
prefix's last token and that token, encoded together, stay as they are. So one state per trie node,
the last token of its prefix, is enough: a node's state comes from the longest vocabulary token that
ends there and is compatible with the state before it. The trie of a batch's distinct words is walked
depth first; only the path to the current node is held, with the encoding of each prefix on it, so
that a prefix shared by many words is encoded once.
"""

from __future__ import annotations

import functools
import gc
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretrace.llm.tokens import _byte_letters

# A surely visible character followed by sure white space: no piece of the pre-tokenizer crosses.
_UNIT = re.compile(r".+?(?:(?<=[!-~])(?=[\t-\r ])|\Z)", re.S)
# A word of letters, then other signs without an apostrophe: two pieces, whatever comes before.
# After a line feed, a piece of its own, there may be two more.
_WORD = r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)"
_PLAIN = re.compile(f"{_WORD}(?:\n{_WORD})?")
PAIRS = 150_000
UNITS = 120_000
BATCH_BYTES = 8 << 20


class Trie:
    """Encodings of the words of a trie, from one state per node: the last token so far."""

    def __init__(self, vocabulary: dict[str, int], merges: Iterable, limit: int = PAIRS):
        parts = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.limit = limit
        self.rank = {(vocabulary[a], vocabulary[b]): k for k, (a, b) in enumerate(parts)}
        if len({a + b for a, b in parts}) < len(parts):
            raise ValueError("two merges make one token")
        self._spines(vocabulary, parts)
        self.ending = {t: i for t, i in vocabulary.items() if i in self.reached}
        self.beginnings = {t[:n] for t in self.ending for n in range(1, len(t) + 1)}
        # Ends of a prefix that begin some token, as an automaton filled in when first needed.
        self.state_of, self.states, self.tokens_at, self.goto = {"": 0}, [""], [()], [{}]
        self.pairs: dict[int, bool] = {}

    def _spines(self, vocabulary: dict[str, int], parts: list[tuple[str, str]]) -> None:
        """For each token, what stands at its two ends while it is being merged, each with the rank
        of the merge that uses it up; and the tokens that their own text is encoded to."""
        top = len(parts)
        self.right = {i: ((i, top),) for i in vocabulary.values()}
        self.left = dict(self.right)
        self.reached = {i for t, i in vocabulary.items() if len(t) == 1}
        for rank, (a, b) in enumerate(parts):
            x, y, made = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.right[made] = ((made, top), (y, rank), *self.right[y][1:])
            self.left[made] = ((made, top), (x, rank), *self.left[x][1:])
            if x in self.reached and y in self.reached and self.compatible(x, y, below=rank):
                self.reached.add(made)

    def compatible(self, a: int, b: int, below: int | None = None) -> bool:
        """Whether tokens a and b, next to each other, stay as they are: no merge (of a rank under
        ``below``) joins what stands on both sides of the border before either is used up. Of equal
        ranks the leftmost merge comes first."""
        below = len(self.rank) if below is None else below
        for x, x_used in self.right[a]:
            for y, y_used in self.left[b]:
                rank = self.rank.get((x, y))
                if rank is not None and rank < below and rank < x_used and rank <= y_used:
                    return False
        return True

    def _step(self, state: int, letter: str) -> int:
        """The longest end of a state's text and one more letter that begins a token."""
        text = self.states[state] + letter
        while text not in self.beginnings:
            text = text[1:]
            if not text:
                raise ValueError(f"no token for {letter!r}")
        if (found := self.state_of.get(text)) is None:
            found = self.state_of[text] = len(self.states)
            self.states.append(text)
            self.goto.append({})
            ends = [text[i:] for i in range(len(text))]
            self.tokens_at.append(tuple(
                (len(t), self.ending[t], array("i", [self.ending[t]]).tobytes()) for t in ends if t in self.ending))
        self.goto[state][letter] = found
        return found

    def encodings(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Each distinct word with its ids, four bytes each. Words in sorted order are the leaves of
        their trie, depth first: of the path to the word before, what both share is kept."""
        tokens_at, goto, pairs = self.tokens_at, self.goto, self.pairs
        last, at, ids, before = [-1], [0], [b""], ""
        for word in sorted(set(words)):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], at[shared + 1 :], ids[shared + 1 :]
            state, end = at[shared], shared
            for letter in word[shared:]:
                end += 1
                if (onward := goto[state].get(letter)) is None:
                    onward = self._step(state, letter)
                state = onward
                for length, token, own in tokens_at[state]:
                    start = end - length
                    if not start:
                        break
                    pair = last[start] << 32 | token
                    if (fits := pairs.get(pair)) is None:
                        fits = pairs[pair] = self.compatible(last[start], token)
                    if fits:
                        break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
                last.append(token)
                at.append(state)
                ids.append(ids[start] + own)
            before = word
            yield word, ids[-1]
        if len(pairs) > self.limit:
            pairs.clear()


class Encoder:
    """Texts to ids and back, for a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str, limit: int = UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                               "byte_fallback", "ignore_merges"))
        pre = content["pre_tokenizer"] or {}
        added = content["added_tokens"]
        if not (plain and content["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                and pre.get("use_regex") and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)):
            raise ValueError("needs a plain byte-level vocabulary")
        self.pieces = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.trie, self.limit = Trie(model["vocab"], model["merges"]), limit
        self.added = {t["content"]: np.int32(t["id"]).tobytes() for t in added}
        self.cut = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.added, key=len, reverse=True))) if added else None
        self.letters = _byte_letters()
        # Units as they stand, and units after one blank, kept without it; those of the last two
        # fillings, so that frequent ones outlive a full table.
        self.whole: dict[str, bytes] = {}
        self.after_blank: dict[str, bytes] = {}
        self.older: tuple[dict, dict] = ({}, {})

    def _pieces(self, unit: str, blank: str) -> list[str]:
        """What the pre-tokenizer makes of a unit, in the letters that stand for bytes."""
        before = self.letters[32] if blank else ""
        if unit.isascii() and unit.isalpha():
            return [before + unit]
        if (plain := _PLAIN.fullmatch(unit)) is None:
            return [p for p, _ in self.pieces(blank + unit)]
        word, signs, second, more = plain.groups("")
        found = [before + self._written(word), signs, self.letters[10], self._written(second), more] if second else [
            before + self._written(word), signs]
        return [p for p in found if p]

    def _written(self, word: str) -> str:
        return word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))

    def _learn(self, units: list[list[str]], known: dict[str, bytes], blank: str) -> None:
        """Ids of the units that are new: their pieces make up one trie."""
        older, new, pieces = self.older[bool(blank)], {}, []
        for unit in set().union(*units).difference(known):
            if (found := older.get(unit)) is None:
                new[unit] = found = self._pieces(unit, blank)
                pieces += found
            else:
                known[unit] = found
        if new:
            ids = dict(self.trie.encodings(pieces))
            for unit, found in new.items():
                known[unit] = ids[found[0]] if len(found) == 1 else b"".join(map(ids.__getitem__, found))

    def _units(self, text: str) -> tuple[list[str], list[str]]:
        """Units that stand as they are, then units that follow one blank each."""
        if "  " not in text and not text.endswith(" "):
            first, *rest = text.split(" ")
            return ([first] if first else []), rest
        return _UNIT.findall(text), []

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        if len(self.whole) + len(self.after_blank) > self.limit:
            self.older = (self.whole, self.after_blank)
            self.whole, self.after_blank = {}, {}
        cut = [[t] if self.cut is None or not any(a in t for a in self.added) else [p for p in self.cut.split(t) if p] for t in texts]
        units = [[part if part in self.added else self._units(part) for part in parts] for parts in cut]
        split = [p for parts in units for p in parts if not isinstance(p, str)]
        self._learn([whole for whole, _ in split], self.whole, "")
        self._learn([after for _, after in split], self.after_blank, " ")
        whole, after = self.whole.__getitem__, self.after_blank.__getitem__
        return [b"".join(self.added[p] if isinstance(p, str) else b"".join(map(whole, p[0])) + b"".join(map(after, p[1])) for p in parts)
                for parts in units]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary file; its tables are bounded."""
    found = Encoder(path)
    gc.freeze()  # it lives as long as the worker: no need to look through it again and again
    return found


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes that each id of a byte-level vocabulary file stands for."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    byte = {letter: bytes([b]) for b, letter in enumerate(_byte_letters())}
    found = {i: b"".join(map(byte.__getitem__, t)) for t, i in content["model"]["vocab"].items()}
    return found | {t["id"]: t["content"].encode() for t in content["added_tokens"]}


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts in parts of bounded size; one longer text is a part of its own."""
    for batch in batches:
        begun, held, size = 0, [], 0
        for k, value in enumerate(batch.column(1)):
            held.append(value.as_py())
            size += len(held[-1])
            if size >= BATCH_BYTES:
                yield batch.column(0).slice(begun, len(held)), held
                begun, held, size = k + 1, [], 0
        if held:
            yield batch.column(0).slice(begun, len(held)), held


def _decoded(flat: np.ndarray, cuts: np.ndarray, bytes_of) -> list[str]:
    return [b"".join(map(bytes_of, flat[a:b].tolist())).decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


def encoded(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", with_decoded: bool = False) -> DataFrame:
    """Per row of ``docs``: its id and the token ids of its whole text; ``with_decoded``, also the text
    that these ids stand for, as from decoded() without a second pass.

    Equal to the library's encode() without special tokens around the text, truncation or padding;
    special tokens written in a text are their own ids, as there. A null or empty text has no ids; a
    null id is kept; repeated rows are repeated; an empty table gives an empty one; other columns,
    whatever their names, are left out. Nothing is shuffled; a worker's table of units
    is begun anew when it reaches its limit."""
    kind = docs.schema[id].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for keys, texts in _batched(batches):
            found = known.encode(texts)
            cuts, flat = np.r_[0, np.cumsum([len(f) // 4 for f in found])].astype(np.int32), np.frombuffer(b"".join(found), "<i4")
            columns = [keys, pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))]
            if with_decoded:
                columns.append(pa.array(_decoded(flat, cuts, token_bytes(path).__getitem__), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[id, "ids", "text"][: len(columns)])

    rows = docs.select(id, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text__"))
    return rows.mapInArrow(encode, f"`{id}` {kind}, ids array<int>" + (", text string" if with_decoded else ""))


def decoded(tokens: DataFrame, path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row of ``tokens``: its id, its token ids and the text they stand for, special tokens
    included. Null ids count as none; bytes that are no UTF-8 become the replacement character;
    an id outside the vocabulary is an error. Other cases as in encoded()."""
    kind = tokens.schema[id].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = token_bytes(path).__getitem__
        for batch in batches:
            cuts, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            begun = 0
            while begun < batch.num_rows:
                upto = max(begun + 1, int(np.searchsorted(cuts, cuts[begun] + BATCH_BYTES // 8, "right")) - 1)
                texts = pa.array(_decoded(flat, cuts[begun : upto + 1], bytes_of), pa.string())
                part = batch.slice(begun, upto - begun)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], names=[id, "ids", "text"])
                begun = upto

    rows = tokens.select(id, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("__ids__"))
    return rows.mapInArrow(decode, f"`{id}` {kind}, ids array<int>, text string")
