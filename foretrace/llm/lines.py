"""Keep one line of each group of similar lines in the whole corpus.

A line's character shingles give MinHash signatures; bands with high recall generate candidates,
exact Jaccard similarity verifies them, and the links' components, found by alternating stars,
are the groups. The first line of a group, by document and position, stays.

Lines are compared with A-Z lower-cased and white space made one blank. Equal lines have one
64-bit id and are one item of the search, however often they occur.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.llm.hashing import MinHash, Spans, band_keys, mixed, packed_bits
from foretrace.llm.links import similar_components
from foretrace.llm.sketches import Bits, cell_bits, count_min
from foretrace.llm.store import keep, with_bytes

SHINGLE = 8
PERCENT = 80
PERMUTATIONS, BITS = 48, 4
BANDS, ROWS = 12, 4  # a pair at 0.8 shares no band 18 times in 10,000, one at 0.9 hardly ever
FLOOR = 0.2
CHUNK = 60_000
_LAST = (1 << 63) - 1
_MARK = "__removed_lines__"
_BLANKS = bytes.maketrans(b"\t\v\f\r", b"    ")


@functools.lru_cache(maxsize=1)
def _tools() -> tuple[Spans, MinHash, np.ndarray]:
    return Spans(0), MinHash(PERMUTATIONS, seed=4), np.random.default_rng(11).integers(0, 1 << 64, 1 << 16, dtype=np.uint64)


def plain_lines(text: bytes) -> tuple[list[int], list[str]]:
    """Numbers and compared forms of the lines that have a word."""
    flat = text.lower().translate(_BLANKS)
    while b"  " in flat:
        flat = flat.replace(b"  ", b" ")
    numbers, lines = [], []
    for k, line in enumerate(flat.decode("utf-8", "replace").split("\n")):
        if line := line.strip(" "):
            numbers.append(k)
            lines.append(line)
    return numbers, lines


class _Lines:
    """Prefix sums over the code points of some lines, and where each line starts and ends."""

    def __init__(self, lines: list[str]):
        self.spans, _, table = _tools()
        points = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4")
        if len(points) >= len(self.spans.up):
            self.spans.grow(2 * len(points))
        if len(points) and points.max() > 0xFFFF:
            values = table[points & np.uint32(0xFFFF)] + mixed((points >> np.uint32(16)).astype(np.uint64)) * np.uint64(2)
        else:
            values = table[points]
        values *= self.spans.up[: len(points)]
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(values, out=self.sums[1:])
        length = np.array([len(x) for x in lines], np.int64)
        self.ends = np.cumsum(length)
        self.starts = self.ends - length

    def ids(self) -> np.ndarray:
        return self.spans.hashes(self.sums, self.starts, self.ends).view(np.int64)

    def shingles(self, some: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the shingles of all (or ``some``) lines, in order, not yet mixed, and where each
        line's begin. A line shorter than a shingle is one itself."""
        starts, own_ends = self.starts[some], self.ends[some]
        length = own_ends - starts
        n = np.maximum(1, length - SHINGLE + 1)
        runs = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(starts - runs, n)
        ends = at + SHINGLE
        short = np.flatnonzero(length < SHINGLE)
        ends[runs[short]] = own_ends[short]
        return (self.sums[ends] - self.sums[at]) * self.spans.down[at], runs

    def upper_halves(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The upper halves of the hashes of shingles() of the lines that are True in ``some``, between others that
        are to be passed over, and where those of each line begin and end. Nothing is gathered place by place."""
        length, n = self.ends - self.starts, len(self.sums) - 1
        out, whole = np.zeros(n + 1, np.uint32), max(0, n - SHINGLE + 1)
        hashes = self.sums[SHINGLE:] - self.sums[:whole]
        hashes *= self.spans.down[:whole]
        hashes >>= np.uint64(32)
        out[:whole] = hashes
        short = length < SHINGLE
        at = self.starts[short]
        out[at] = ((self.sums[self.ends[short]] - self.sums[at]) * self.spans.down[at]) >> np.uint64(32)
        if not some.all():
            out, length = out[np.r_[np.repeat(some, length), True]], length[some]
        starts = np.cumsum(length) - length
        return out, starts, starts + np.maximum(1, length - SHINGLE + 1)


def line_ids(lines: list[str]) -> np.ndarray:
    return _Lines(lines).ids()


def shingle_set(line: bytes) -> np.ndarray:
    return np.unique(_Lines([line.decode("utf-8", "replace")]).shingles()[0])


def shingle_sets(lines: list[bytes]) -> list[np.ndarray]:
    """``shingle_set`` of each line; many are hashed together."""
    if not lines:
        return []
    hashes, runs = _Lines([line.decode("utf-8", "replace") for line in lines]).shingles()
    for own in np.split(hashes, runs[1:]):
        own.sort()
    new = np.r_[True, hashes[1:] != hashes[:-1]]
    new[runs] = True
    return np.split(hashes[new], np.cumsum(new)[runs[1:]] - 1)


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds what tells documents apart: the doc_id (none: larger than any) and the text."""
    return docs.withColumn("__doc__", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn(
        "__crc__", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def signed_lines(docs: DataFrame) -> DataFrame:
    """doc, crc, line, id, keys, sig of every line that has a word. A task signs a line once;
    where it meets it again, keys and sig are empty."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: list[tuple] = []  # of a text: doc, crc, numbers of its lines
        lines: list[str] = []
        signed: set[int] = set()

        def lists(values: np.ndarray, new: np.ndarray) -> pa.Array:
            ends = np.cumsum(new * values.shape[1])
            return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values.reshape(-1)))

        def send() -> pa.RecordBatch:
            own = _Lines(lines)
            ids = own.ids()
            new = np.zeros(len(ids), bool)
            for k, i in enumerate(ids.tolist()):
                if i not in signed:
                    signed.add(i)
                    new[k] = True
            keys = sig = np.zeros((0, 1), np.int64)
            if new.any():
                low = _tools()[1].minima_of_spans(*own.upper_halves(new)).T
                keys, sig = band_keys(low, BANDS, ROWS), packed_bits(low, BITS)
            n = [len(x[2]) for x in place]
            docs, crcs = (np.repeat(np.array([x[k] for x in place], np.int64), n) for k in (0, 1))
            numbers = np.concatenate([np.array(x[2], np.int32) for x in place])
            out = pa.RecordBatch.from_arrays(
                [*map(pa.array, (docs, crcs, numbers, ids)), lists(keys, new), lists(sig, new)],
                names=["doc", "crc", "line", "id", "keys", "sig"])
            place.clear()
            lines.clear()
            if len(signed) > 500_000:
                signed.clear()
            return out

        held = 0
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                numbers, own = plain_lines(text)
                place.append((doc, zlib.crc32(text), numbers))
                lines += own
                held += len(text)
                if held >= CHUNK and lines:
                    yield send()
                    held = 0
        if lines:
            yield send()

    plain = with_bytes(_keyed(docs.select("doc_id", "text")).withColumnRenamed("__doc__", "doc"), "doc")
    return plain.mapInArrow(sign, "doc long, crc long, line int, id long, keys array<long>, sig array<long>")


def _place_hash(doc: Column, crc: Column) -> Column:
    return F.xxhash64(doc, crc)


def _places(rows: DataFrame, doc: str, crc: str) -> Bits:
    """A filter of fixed size that hits every document of the rows and few others."""
    hashed = keep(rows.select(_place_hash(F.col(doc), F.col(crc)).alias("h")).distinct())  # counted and read
    return count_min(hashed, lambda batch: iter([batch["h"].to_numpy(np.int64).view(np.uint64)]), cell_bits(hashed.count()), level=1)


def _is_hit(places: Bits, spark):
    shared = spark.sparkContext.broadcast(places)

    @F.pandas_udf("boolean")
    def hit(h: pd.Series) -> pd.Series:
        return pd.Series(shared.value.hit(h.to_numpy(np.int64)))

    return hit


def _texts(docs: DataFrame, lines: DataFrame, wanted: Bits) -> DataFrame:
    """id, text of lines that the filter hits, read from the first document of each; a task
    sends each once."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(wanted)
    hit = _is_hit(wanted, spark)
    first = lines.filter(hit("id")).groupBy("id").agg(F.min(F.struct("doc", "crc")).alias("p")).select("p.doc", "p.crc")
    # Tested where the lines are read: a second Python step in one stage would hold a second worker.
    places = spark.sparkContext.broadcast(_places(first, "doc", "crc"))
    docs = _keyed(docs.select("doc_id", "text")).withColumn("h", _place_hash(F.col("__doc__"), F.col("__crc__")))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: set[int] = set()

        def found(lines: list[str]) -> Iterator[tuple[int, bytes]]:
            ids = line_ids(lines)
            for k in np.flatnonzero(shared.value.hit(ids)):
                if (i := int(ids[k])) not in sent:
                    sent.add(i)
                    yield i, lines[k].encode()

        for batch in batches:
            rows, lines, held = [], [], 0
            for text in batch["text"][places.value.hit(batch["h"].to_numpy(np.int64))]:
                lines += plain_lines(text)[1]
                held += len(text)
                if held >= CHUNK:
                    rows += found(lines)
                    lines, held = [], 0
            rows += found(lines)
            if len(sent) > 500_000:
                sent.clear()
            yield pd.DataFrame(rows, columns=["id", "text"])

    return with_bytes(docs, "h").mapInPandas(pick, "id long, text binary")


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """__doc__, __crc__, __removed_lines__: numbers (from 0) of the lines to leave out."""
    lines = keep(signed_lines(docs))
    words = PERMUTATIONS * BITS // 64
    known = similar_components(lines.select("id", "keys", "sig"), words, BITS, FLOOR,
                               lambda wanted: _texts(docs, lines, wanted), shingle_set, percent, shingle_sets)
    place = F.struct("doc", "crc", "line")
    firsts = lines.groupBy("id").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    # A line that occurs once and is linked with none loses nothing.
    firsts = firsts.join(known.hint("shuffle_hash"), "id", "left").filter("n > 1 OR component IS NOT NULL")
    firsts = keep(firsts.withColumn("component", F.coalesce("component", "id")))
    groups = firsts.groupBy("component").agg(F.min("first").alias("stays"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    stays = firsts.select("id", "component").join(groups, "component").select("id", "stays")
    gone = lines.select("id", "doc", "crc", "line").join(stays.hint("shuffle_hash"), "id").filter(place != F.col("stays"))
    return gone.groupBy(F.col("doc").alias("__doc__"), F.col("crc").alias("__crc__")).agg(F.collect_set("line").alias(_MARK))


def _marked(docs: DataFrame, percent: int) -> DataFrame:
    """Only the texts of documents that lose a line meet their marks in a shuffle."""
    removed = keep(removed_lines(docs, percent))
    some = _is_hit(_places(removed, "__doc__", "__crc__"), docs.sparkSession)
    keyed = _keyed(docs).withColumn("__hit__", some(_place_hash(F.col("__doc__"), F.col("__crc__"))))
    changed = keyed.filter("__hit__").join(removed.hint("shuffle_hash"), ["__doc__", "__crc__"], "left")
    same = keyed.filter(~F.col("__hit__")).withColumn(_MARK, F.lit(None).cast("array<int>"))
    return changed.select(*docs.columns, _MARK).union(same.select(*docs.columns, _MARK))


def _kept(text: Column) -> Column:
    """The text without the marked lines; untouched where none is marked."""

    def rest(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(_MARK))
        return F.array_join(F.transform(stay, lambda i: lines[i]), "\n")

    # As the element of an array the lines are a variable: they are split once, not again for each line that stays.
    return F.when(F.col(_MARK).isNull(), text).otherwise(F.transform(F.array(F.split(text, "\n", -1)), rest)[0])


def _n_lines(text: Column) -> Column:
    return F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; all columns and rows stay.

    Lines without a word are never removed. A null text stays null, an empty one empty. Rows
    with equal doc_id and text are one document and keep the same lines; of different texts
    under one doc_id, and of documents without one, the order of their checksums decides which is first."""
    marked = _marked(docs, percent)
    return marked.select(*[_kept(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def line_report(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_lines (\\n-split; none in a null text), n_removed and the kept text of every document."""
    marked = _marked(docs.select("doc_id", "text"), percent)
    return marked.select("doc_id", _n_lines(F.col("text")).alias("n_lines"),
                         F.coalesce(F.size(_MARK).cast("long"), F.lit(0)).alias("n_removed"), _kept(F.col("text")).alias("text"))
