"""Quality rules: simple counts, then bands of n-gram perplexity for each language.

The model is a modified Kneser-Ney model of three characters, counted by Spark over all texts, one
for each language. A character is its code point (the ten digits count as one), so no two runs share an entry and
the model grows with what the texts hold. It stays a table of Spark: texts are dealt into blocks of
a language, the runs of a block are joined with their ratings, and a task gets the texts and the
ratings of one block at a time. Neither the driver nor a task holds a language's model.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.llm.hashing import Spans, joined_words, mixed, word_ngrams
from foretrace.llm.store import keep
from foretrace.llm.substrings import covered

ORDER = 3
CHAR_BITS = 21  # of a code point; three of them fit a long
# A character a language never showed gets an even share among at least so many.
LEAST_ALPHABET = 128
MIN_WORDS, MAX_REPEATED_PERCENT, REPEAT_WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
# Bands in robust standard steps (median absolute deviations) around a language's median; texts
# shorter than STEADY_CHARS vary more and get wider ones.
LOWER, UPPER, STEADY_CHARS = 5.0, 6.0, 600.0
LEAST_DEVIATION = 0.005
# Each run is rated by so many languages in one join; the best of all of them is kept.
LANGUAGES_AT_ONCE = 16
# Entries a counting task holds, and runs of the texts that are scored together.
FLUSH, BLOCK_RUNS = 1 << 20, 1 << 22
MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_grams long, "
            "log_perplexity double, mixed double")


@functools.lru_cache(maxsize=1)
def _spans() -> Spans:
    return Spans(0)


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    joined = joined_words(text)
    if not joined:
        return 0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0
    n = joined.count(b" ") + 1
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line.strip():
            again += line in seen
            seen.add(line)
    repeated = 0
    if n > REPEAT_WINDOW:
        _, where, times = np.unique(word_ngrams(_spans(), joined, REPEAT_WINDOW), return_inverse=True, return_counts=True)
        if len(times) < len(where):
            repeated = int(covered(n, np.flatnonzero(times[where] > 1), REPEAT_WINDOW).sum())
    return n, len(joined.decode("utf-8", "replace")) - n + 1, len(text) - len(text.translate(None, SYMBOLS)), again, repeated


def ngram_codes(text: bytes) -> np.ndarray:
    """Codes of all runs of ORDER characters in the words, blanks between and around: their code
    points side by side, so equal codes are equal runs. Digits count as 0."""
    words = b" " + joined_words(text) + b" "
    points = np.frombuffer(words.decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.int64)
    points[(points >= 48) & (points <= 57)] = 48
    out = np.zeros(max(0, len(points) - ORDER + 1), np.int64)
    for k in range(ORDER if len(out) else 0):
        out = (out << CHAR_BITS) | points[k : k + len(out)]
    return out


def _language() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def _added(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, with the sum of its numbers."""
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(n, first)


def ngram_counts(docs: DataFrame) -> DataFrame:
    """lang, code, n over all texts; a task adds up what it reads, FLUSH entries at most, before
    sending it."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, runs: list[np.ndarray]) -> None:
            codes, n = np.unique(np.concatenate(runs), return_counts=True)
            if not len(codes):
                return
            if lang in held:
                codes, n = _added(np.concatenate([held[lang][0], codes]), np.concatenate([held[lang][1], n]))
            held[lang] = codes, n

        def sent() -> Iterator[pd.DataFrame]:
            for lang in list(held):
                codes, n = held.pop(lang)
                yield pd.DataFrame({"lang": lang, "code": codes, "n": n})

        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                runs, size = [], 0
                for text in texts:
                    runs.append(ngram_codes(text))
                    size += len(runs[-1])
                    if size >= FLUSH:
                        add(lang, runs)
                        runs, size = [], 0
                if runs:
                    add(lang, runs)
                if sum(len(codes) for codes, _ in held.values()) >= FLUSH:
                    yield from sent()
        yield from sent()

    plain = docs.select(_language().alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return plain.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _last(level: int) -> Column:
    """The last ``level`` characters of a code."""
    return F.col("code").bitwiseAND(F.lit((1 << (CHAR_BITS * level)) - 1).cast("long"))


def kneser_ney(counted: DataFrame) -> DataFrame:
    """lang, level (1 .. ORDER), code, p of kind "p", and for contexts of that length their backoff
    weight, of kind "b". Level 0 of kind "b" is the even share of a character.

    Highest level: counts; below: in how many contexts a run was seen (continuations). The three
    discounts of a level come from its counts of counts; levels are interpolated."""
    levels = {ORDER: counted}
    for level in range(ORDER - 1, 0, -1):
        shorter = levels[level + 1].select("lang", _last(level).alias("code"))
        levels[level] = shorter.groupBy("lang", "code").agg(F.count(F.lit(1)).alias("n"))
    share = 1.0 / F.greatest(F.lit(LEAST_ALPHABET), F.count(F.lit(1)) + 1)
    even = keep(levels[1].groupBy("lang").agg(share.alias("p")).select("lang", F.lit(0).alias("level"), F.lit(0).cast("long").alias("code"), "p"))
    out, below = even.withColumn("kind", F.lit("b")), even.select("lang", "code", "p")
    for level in range(1, ORDER + 1):
        rows = levels[level].withColumn("ctx", F.shiftright("code", CHAR_BITS))
        of = [F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
        met = rows.groupBy("lang").agg(*of)
        y = F.col("n1") / F.greatest(F.lit(1.0), F.col("n1") + 2 * F.col("n2"))
        step = lambda k: F.greatest(F.lit(0.0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.greatest(F.lit(1.0), F.col(f"n{k}")))
        # Written, a row per language: the optimizer then sees how small it is.
        met = keep(met.select("lang", step(1).alias("d1"), step(2).alias("d2"), step(3).alias("d3")))
        times = lambda met_n: F.sum(met_n.cast("long"))
        contexts = rows.groupBy("lang", "ctx").agg(
            F.sum("n").alias("total"), times(F.col("n") == 1).alias("of1"), times(F.col("n") == 2).alias("of2"), times(F.col("n") > 2).alias("of3")).join(met, "lang")
        freed = F.col("d1") * F.col("of1") + F.col("d2") * F.col("of2") + F.col("d3") * F.col("of3")
        contexts = contexts.select("lang", "ctx", "total", (freed / F.col("total")).alias("backoff"), "d1", "d2", "d3")
        rows = rows.join(contexts, ["lang", "ctx"]).withColumn(
            "d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        rows = rows.withColumn("short", _last(level - 1)).join(
            below.select("lang", F.col("code").alias("short"), F.col("p").alias("lower")), ["lang", "short"])
        below = keep(rows.select("lang", "code", ((F.col("n") - F.col("d")) / F.col("total") + F.col("backoff") * F.col("lower")).alias("p")))
        out = out.union(below.select("lang", F.lit(level).alias("level"), "code", "p").withColumn("kind", F.lit("p"))).union(
            contexts.select("lang", F.lit(level).alias("level"), F.col("ctx").alias("code"), F.col("backoff").alias("p")).withColumn("kind", F.lit("b")))
    return keep(out)


def rated(model: DataFrame) -> DataFrame:
    """lang, code, own, best: for each run that a language's texts hold its probability there, and the
    greatest one that any language gives it, backed off where that language lacks it."""
    def part(kind: str, level: int) -> DataFrame:
        return model.filter((F.col("kind") == kind) & (F.col("level") == level)).select("lang", "code", "p")

    own = part("p", ORDER).withColumnRenamed("p", "own")
    codes = {ORDER: keep(own.select("code").distinct())}
    for level in range(ORDER - 1, 0, -1):
        codes[level] = codes[level + 1].select(_last(level).alias("code")).distinct()
    names = sorted(r["lang"] for r in part("b", 0).collect())
    best = None
    for block in [names[i : i + LANGUAGES_AT_ONCE] for i in range(0, len(names), LANGUAGES_AT_ONCE)]:
        low = part("b", 0).filter(F.col("lang").isin(block))
        languages = F.broadcast(low.select("lang"))
        for level in range(1, ORDER + 1):
            weights = part("b", level).select("lang", F.col("code").alias("ctx"), F.col("p").alias("weight"))
            rows = codes[level].crossJoin(languages).withColumns({"ctx": F.shiftright("code", CHAR_BITS), "short": _last(level - 1)})
            rows = rows.join(part("p", level), ["lang", "code"], "left").join(weights, ["lang", "ctx"], "left").join(
                low.select("lang", F.col("code").alias("short"), F.col("p").alias("lower")), ["lang", "short"])
            # A context never met passes all its mass on.
            low = rows.select("lang", "code", F.coalesce("p", F.coalesce("weight", F.lit(1.0)) * F.col("lower")).alias("p"))
        of_block = keep(low.groupBy("code").agg(F.max("p").alias("best")))
        best = of_block if best is None else best.union(of_block)
    if best is None:
        return own.withColumn("best", F.col("own"))
    if len(names) > LANGUAGES_AT_ONCE:
        best = best.groupBy("code").agg(F.max("best").alias("best"))
    return keep(own.join(best, "code").select("lang", "code", "own", "best"))


class Model:
    """One language that fits in memory, for texts other than those counted: probabilities and backoff
    weights in arrays sorted by hash."""

    def __init__(self, rows: pd.DataFrame):
        self.arrays = {}
        for (kind, level), part in rows.groupby(["kind", "level"]):
            hashes = mixed(part["code"].to_numpy(np.uint64))
            order = np.argsort(hashes)
            self.arrays[kind, int(level)] = hashes[order], part["p"].to_numpy(np.float64)[order].astype(np.float32)

    def find(self, kind: str, level: int, codes: np.ndarray) -> np.ndarray:
        """The entries of the codes; 0 where there is none."""
        hashes, values = self.arrays[kind, level]
        wanted = mixed(codes.astype(np.uint64))
        at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        return np.where(hashes[at] == wanted, values[at], np.float32(0))

    def log_probabilities(self, at: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of each code's last character after the two before it."""
        p = self.find("p", ORDER, at).astype(np.float64)
        weight = np.ones(len(at))
        for level in range(ORDER, 0, -1):
            todo = np.flatnonzero(p == 0)
            if not len(todo):
                break
            context = (at[todo] & ((1 << (CHAR_BITS * level)) - 1)) >> CHAR_BITS
            b = self.find("b", level, context)
            weight[todo] *= np.where(b > 0, b, 1)  # a context never met passes all its mass on
            if level > 1:
                p[todo] = weight[todo] * self.find("p", level - 1, at[todo] & ((1 << (CHAR_BITS * (level - 1))) - 1))
            else:
                p[todo] = weight[todo] * self.find("b", 0, np.zeros(len(todo), np.int64))
        return np.log(p)


def _bytes(text: pa.Scalar) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def _distinct_codes(texts: pa.Table) -> pa.Table:
    """The runs of one block of texts, each once."""
    found, held = np.zeros(0, np.int64), []
    for k, text in enumerate(texts["text"], 1):
        held.append(ngram_codes(_bytes(text)))
        if k % 256 == 0 or k == texts.num_rows:
            found, held = np.unique(np.concatenate([found, *held])), []
    one = lambda name: pa.repeat(texts[name][0], len(found))
    return pa.table({"__lang__": one("__lang__"), "__block__": one("__block__"), "code": found})


def _judge(columns: list[str]):
    """The named columns of a block of texts and their measures, from the ratings of the block's runs."""

    def judge(texts: pa.Table, ratings: pa.Table) -> pa.Table:
        codes = ratings["code"].to_numpy()
        order = np.argsort(codes)
        codes = codes[order]
        own, best = (-np.log(ratings[name].to_numpy()[order]) for name in ("own", "best"))
        found = []
        for text in texts["text"]:
            t = _bytes(text)
            c = counts(t)
            runs = ngram_codes(t)
            at = np.searchsorted(codes, runs)
            rates = (float(own[at].mean()), float(best[at].mean())) if c[0] else (None, None)
            found.append((*c, len(runs), *rates))
        types = {"long": pa.int64(), "double": pa.float64()}
        fields = [x.split() for x in MEASURES.split(", ")]
        values = [pa.array([row[i] for row in found], types[kind]) for i, (_, kind) in enumerate(fields)]
        return texts.select(columns).append_column("__q__", pa.StructArray.from_arrays(values, [name for name, _ in fields]))

    return judge


def scored(docs: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` without the columns in ``drop``, with a struct __q__: the counts, n_grams, log_perplexity (null in a text without words)
    and ``mixed``: the same with each run rated by whichever language expects it most.

    Texts of a language are dealt into blocks of about BLOCK_RUNS runs by a hash of their rows."""
    counted = keep(ngram_counts(docs))
    rates = rated(kneser_ney(counted))
    blocks = keep(counted.groupBy(F.col("lang").alias("__lang__")).agg(F.ceil(F.sum("n") / BLOCK_RUNS).cast("int").alias("__block__")))
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t])
    dealt = docs.withColumn("__lang__", _language()).join(
        blocks, "__lang__", "left").withColumn("__block__", F.pmod(hashed, F.coalesce("__block__", F.lit(1))).cast("int"))
    columns = [c for c in docs.columns if c not in drop]
    keys = ["__lang__", "__block__"]
    needed = dealt.groupBy(*keys).applyInArrow(_distinct_codes, "__lang__ string, __block__ int, code long")
    needed = needed.join(rates.withColumnRenamed("lang", "__lang__"), ["__lang__", "code"])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in columns]).schema])
    return dealt.groupBy(*keys).cogroup(needed.groupBy(*keys)).applyInArrow(_judge(columns), f"{schema}, __q__ struct<{MEASURES.replace(' ', ': ').replace(',: ', ', ')}>")


def bands(marks: DataFrame, measure: str = "log_perplexity") -> DataFrame:
    """lang, middle, deviation: exact medians over the documents that pass the simple rules, from
    values rounded to four places, so that what a median has to hold is bounded."""
    q = F.col("__q__")
    passing = marks.filter(~_base_failed() & q[measure].isNotNull()).select(
        _language().alias("lang"), F.round(q[measure], 4).alias("x"), q["n_grams"].alias("n"))
    # Written, a row per language: the optimizer then sees how small it is and no language's documents
    # have to meet in one task.
    middle = keep(passing.groupBy("lang").agg(F.percentile("x", 0.5).alias("middle")))
    off = F.round(F.abs(F.col("x") - F.col("middle")) / F.sqrt(1 + STEADY_CHARS / F.col("n")), 4)
    return passing.join(middle, "lang").withColumn("off", off).groupBy("lang", "middle").agg(
        F.greatest(F.percentile("off", 0.5), F.lit(LEAST_DEVIATION)).alias("deviation"))


def _base_failed() -> Column:
    q = F.col("__q__")
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEATED_PERCENT * q["n_words"])


def judged(docs: DataFrame, lower: float = LOWER, upper: float = UPPER, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` without the columns in ``drop``, with __q__, __failed__ and __kept__.

    __failed__: fewer than 20 words, or over 30 percent of the words lie in 8-word windows that
    the text has twice or more. Others are kept if their log perplexity lies in their language's band:
    its median minus ``lower`` to plus ``upper`` deviations. A text above its band is a good one
    with a wrong label, or of several languages, and kept, if it is not above the band of its language's
    mixed ratings either. Null and empty texts fail. A null language
    is one of its own. A language none of whose documents passes the simple rules has no band."""
    marks = keep(scored(docs, drop))
    edges = keep(bands(marks)).toDF("__lang__", "__middle__", "__deviation__")
    joined = marks.withColumn("__lang__", _language()).join(edges, "__lang__", "left")
    joined = joined.join(keep(bands(marks, "mixed")).toDF("__lang__", "__middle2__", "__deviation2__"), "__lang__", "left")
    q = F.col("__q__")
    wide = F.sqrt(1 + STEADY_CHARS / F.greatest(q["n_grams"], F.lit(1)))
    band = lambda x, m, d: x.between(F.col(m) - lower * F.col(d) * wide, F.col(m) + upper * F.col(d) * wide)
    above = q["log_perplexity"] > F.col("__middle__") + upper * F.col("__deviation__") * wide
    inside = band(q["log_perplexity"], "__middle__", "__deviation__") | F.coalesce(
        above & band(q["mixed"], "__middle2__", "__deviation2__"), F.lit(False))
    return joined.withColumn("__failed__", _base_failed()).withColumn("__kept__", ~F.col("__failed__") & F.coalesce(inside, F.lit(True))).drop(
        "__lang__", "__middle__", "__deviation__", "__middle2__", "__deviation2__")
