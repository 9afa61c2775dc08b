"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to a few symbols. Two words one edit apart have reduced words at most one edit
apart, so one of them lies in the one-edit neighbourhood of the other. Being a neighbour is mutual:
each word is sent to those of its own reduced word's neighbours that have one symbol fewer or a higher
one in some place, by a 64-bit hash, and meets there the words that reduce to them; the other half of
the full neighbourhood is sent from the other side. The original strings decide.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretrace.llm.hashing import mixed
from foretrace.llm.store import keep

LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
WORD = re.compile("[A-Za-zÀ-ÿ]+")
# Symbols tried, in turn, until no reduced word stands for more than CROWDED words. With one symbol
# for each letter a reduced word is the word.
SYMBOLS = (8, 16, 32, len(LETTERS))
CROWDED = 1_000
HELD = 200_000  # distinct words that a task adds up before it sends them on
ROWS = 1 << 18  # neighbours made at a time
_U = np.uint64


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text",
                rewrite: Callable[[object, bytes], bytes] | None = None) -> DataFrame:
    """(word, n): how often each word occurs in all texts. Words are runs of A-Z, a-z and U+00C0 to
    U+00FF, with only A-Z lower-cased; ``rewrite`` may give another word (or an empty one, which is
    dropped) for a row's id and a word as UTF-8. Counts are added up in tasks first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())],
                                             names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, found in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in Counter(WORD.findall(found.as_py())).items():
                    low = word.encode().lower()  # of bytes: A-Z alone
                    if rewrite:
                        low = rewrite(key, low)
                    if low:
                        held[low] += n
                if len(held) >= HELD:
                    yield sent()
        yield sent()

    rows = docs.select(id, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text__"))
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def one_dropped(one_in: int) -> Callable[[object, bytes], bytes]:
    """A rewrite that drops one letter of a word in some documents: where ``one_in`` divides the
    checksum of `id:word`, the letter at checksum modulo length. Rows without an id keep theirs."""

    def rewrite(key: object, word: bytes) -> bytes:
        if key is None:
            return word
        h = zlib.crc32(word, zlib.crc32(b"%d:" % key))
        if h % one_in:
            return word
        letters = word.decode()
        at = h % len(letters)
        return (letters[:at] + letters[at + 1 :]).encode()

    return rewrite


def symbol_of(symbols: int, letters: str = LETTERS) -> np.ndarray:
    """The symbol of each code point up to U+00FF. ``letters``, best the most frequent first, are dealt
    to the symbols forwards and backwards in turn: the symbols are alike in weight, and frequent
    letters are told apart."""
    out = np.zeros(256, np.int64)
    for k, letter in enumerate(letters):
        turn, place = divmod(k, symbols)
        out[ord(letter)] = symbols - 1 - place if turn % 2 else place
    return out


def letters_by_use(vocabulary: DataFrame) -> str:
    """All letters, those that most words have most often first."""
    counts = vocabulary.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count()
    n = {r["letter"]: r["count"] for r in counts.collect()}  # one row per letter of LETTERS at most
    return "".join(sorted(LETTERS, key=lambda c: (-n.get(c, 0), c)))


class Reduced:
    """Hashes of reduced words and of their one-edit neighbours, for words of one length."""

    def __init__(self, symbols: int, letters: str = LETTERS):
        self.symbol = symbol_of(symbols, letters)
        self.value = np.random.default_rng(5).integers(0, 1 << 63, symbols, dtype=_U) * _U(2) + _U(1)
        self.base = 0x9E3779B97F4A7C15
        self.inverse = pow(self.base, -1, 1 << 64)

    def _powers(self, n: int) -> np.ndarray:
        return np.cumprod(np.r_[_U(1), np.full(n, self.base, _U)])

    def _sums(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols, and hashes of the first 0, 1, 2 ... symbols, one row per word."""
        codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)
        symbols = self.symbol[codes]
        sums = np.zeros((len(words), codes.shape[1] + 1), _U)
        np.cumsum(self.value[symbols] * self._powers(codes.shape[1])[:-1], axis=1, out=sums[:, 1:])
        return symbols, sums

    def own(self, words: list[str]) -> np.ndarray:
        return mixed(self._sums(words)[1][:, -1] + _U(len(words[0]))).view(np.int64)

    def neighbours(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(which word, key) of the reduced words that come from each one's own by dropping one
        symbol or by raising one, each once."""
        length, power = len(words[0]), self._powers(len(words[0]))
        symbols, sums = self._sums(words)
        whole = sums[:, -1:]
        dropped = mixed(sums[:, :-1] + (whole - sums[:, 1:]) * _U(self.inverse) + _U(length - 1))
        drops = np.ones(symbols.shape, bool)
        drops[:, 1:] = symbols[:, 1:] != symbols[:, :-1]  # of equal neighbours the first
        bare = whole - self.value[symbols] * power[:-1]
        raised = mixed(bare[:, :, None] + power[:-1, None] * self.value + _U(length))
        raises = np.arange(len(self.value)) > symbols[:, :, None]
        which = np.concatenate([np.nonzero(drops)[0], np.nonzero(raises)[0]])
        return which, np.concatenate([dropped[drops], raised[raises]]).view(np.int64)


def _by_length(words: list[str], rows_of: Callable[[int], int]) -> Iterator[np.ndarray]:
    """Places of words of one length, few enough that they make about ROWS rows."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        step = max(1, ROWS // rows_of(int(lengths[same[0]])))
        for k in range(0, len(same), step):
            yield same[k : k + step]


def _own_keys(vocabulary: DataFrame, symbols: int, letters: str) -> DataFrame:
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reduced = Reduced(symbols, letters)
        for batch in batches:
            words, keys = batch.column(0).to_pylist(), np.zeros(batch.num_rows, np.int64)
            for at in _by_length(words, lambda n: n) if words else ():
                keys[at] = reduced.own([words[i] for i in at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], names=["word", "n", "id", "key"])

    return vocabulary.select("word", "n", "id").mapInArrow(keyed, "word string, n long, id long, key long")


def _neighbour_keys(vocabulary: DataFrame, symbols: int, letters: str) -> DataFrame:
    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reduced = Reduced(symbols, letters)
        for batch in batches:
            words, ids = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for at in _by_length(words, lambda n: n * (symbols + 1)) if words else ():
                which, keys = reduced.neighbours([words[i] for i in at])
                yield pa.RecordBatch.from_arrays([pa.array(ids[at][which]), pa.array(keys)], names=["of", "key"])

    return vocabulary.select("word", "id").mapInArrow(sent, "of long, key long")


def _sorted_join(left: DataFrame, right: DataFrame, *args) -> DataFrame:
    """A join that broadcasts neither side. Tables with a row per word or per neighbour are many times
    larger in memory than Spark expects of a file or of what Python steps return."""
    return left.hint("merge").join(right.hint("merge"), *args)


def near_words(vocabulary: DataFrame, symbols: tuple[int, ...] = SYMBOLS, crowded: int = CROWDED) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of words of ``vocabulary`` (word, n; distinct words
    of the letters of WORD) that differ by exactly one inserted, deleted or replaced letter. The
    number of symbols is the first that leaves no reduced word with more than ``crowded`` words; it
    changes the work, never the pairs. An empty vocabulary gives no pairs."""
    numbered = keep(vocabulary.select("word", "n").withColumn("id", F.monotonically_increasing_id()))
    letters = letters_by_use(numbered)
    for size in symbols:
        keyed = keep(_own_keys(numbered, size, letters))
        if size == symbols[-1] or not keyed.groupBy("key").count().filter(F.col("count") > crowded).limit(1).count():
            break
    other = keyed.select("key", F.col("id").alias("near_id"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    one_edit = (F.abs(F.length("word") - F.length("near")) <= 1) & (F.levenshtein("word", "near", 1) == 1)
    # Words of one reduced word meet there, the lower number first; all others at a neighbour.
    alike = _sorted_join(keyed, other, "key").filter((F.col("id") < F.col("near_id")) & one_edit)
    met = _sorted_join(_neighbour_keys(numbered, size, letters), other, "key").drop("key", "near_id")
    apart = _sorted_join(met, numbered, met["of"] == numbered["id"]).filter(one_edit)
    columns = ("word", "n", "near", "near_n")
    found = alike.select(*columns).unionByName(apart.select(*columns))
    both = F.explode(F.array(F.struct(*columns), F.struct(
        F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return found.select(both.alias("pair")).select("pair.*")


def spelling_groups(counts: DataFrame, at_least: int = 3, letters: int = 5, times: int = 2) -> DataFrame:
    """Per word of ``counts`` (word, n) with ``at_least`` occurrences and ``letters`` letters: its
    number of near words; its form, the near word of largest n (ties: smallest in code-point
    order) if that is ``times`` its own n or more, else null; the form's n; and its root, reached
    by following forms to the last.

    A form has at least twice the count, so that a chain of forms is no longer than the largest
    count has bits, and roots need only as many rounds as that length has bits. Words without near
    words are their own roots. An empty table gives an empty one."""
    if times < 2:
        raise ValueError("forms must have twice the count, or chains could be of any length")
    words = keep(counts.filter((F.col("n") >= at_least) & (F.length("word") >= letters)).select("word", "n"))
    best = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    is_form = -F.col("best.less") >= times * F.col("n")
    found = keep(_sorted_join(words, best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    links = found.filter("form is not null").select("word", F.col("form").alias("root"))
    most = _sorted_join(links, words.select(F.col("word").alias("root"), "n"), "root").agg(F.max("n")).first()[0] or 0
    for _ in range(int(most).bit_length().bit_length()):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("__onward__"))
        links = keep(_sorted_join(links, onward, "root", "left").select("word", F.coalesce("__onward__", "root").alias("root")))
    return _sorted_join(found, links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id: str = "doc_id", text: str = "text",
                      rewrite: Callable[[object, bytes], bytes] | None = None, **limits: int) -> DataFrame:
    """spelling_groups() of the words of whole texts. Null, empty and letterless texts add nothing;
    repeated rows count again; ties are settled by code points; an empty table gives an empty one;
    other columns, whatever their names, are not read."""
    return spelling_groups(word_counts(docs, id, text, rewrite), **limits)
