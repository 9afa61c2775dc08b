"""Encode texts word by word, with the ids of words kept in bounded caches.

The vocabulary's normaliser turns every white space into one blank and its pre-tokenizer
never joins characters across white space, so the ids of a text are those of its words, one
after the other. Words are what bytes.split() gives: runs of bytes other than 0x20 and
0x09-0x0D.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

# A word of letters that lower-casing and composing leave one to one, then other signs: two
# units of the pre-tokenizer. The apostrophe may begin a unit of its own, so it is left out.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable
    Latin-1 characters stand for themselves, the others for those from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, n = [], 0
    for b in range(256):
        letters.append(chr(b if b in own else 0x100 + n))
        n += b not in own
    return letters


class WordIds(dict):
    """Word (UTF-8) -> its ids as little-endian 32-bit integers. A word met for the first time
    is encoded; a plain one by the model alone, from the units it has, any other by the whole
    tokenizer. Each cache is emptied when it holds ``limit`` entries."""

    def __init__(self, path: str, limit: int = 300_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.units = Tokenizer.from_file(path), limit, {}
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def unit(self, unit: str) -> bytes:
        if (found := self.units.get(unit)) is None:
            if len(self.units) >= self.limit:
                self.units.clear()
            written = unit if unit.isascii() else "".join(map(self.letters.__getitem__, unit.encode()))
            found = self.units[unit] = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
        return found

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        text = word.decode("utf-8", "replace")
        if m := _PLAIN.fullmatch(text):
            found = self.unit(m[1].lower())
            if m[2]:
                found += self.unit(m[2])
        else:
            found = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        self[word] = found
        return found

    def forget(self) -> None:
        """Free the caches; worker processes outlive their tasks."""
        self.clear()
        self.units.clear()

    def ids(self, text: bytes) -> bytes:
        """The ids of a whole text, four bytes each."""
        return b"".join(map(self.__getitem__, text.split()))


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per worker process and vocabulary file."""
    return WordIds(path)
