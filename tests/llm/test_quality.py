import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from foretrace.llm import quality


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, hit = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            hit.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


TEXTS = [None, "", " \n ", "one", "a\na\n a\nb\n\n\n", "é# x|y <b> ß", " ".join(["p q r s t u v w"] * 5), " ".join("abcdefgh ijklmnop".split() * 8),
         "\n".join(["same line"] * 4 + ["other"]), " ".join(f"w{i}" for i in range(9)), "x " * 9]


@pytest.mark.parametrize("text", TEXTS)
def test_counts_equal_brute_force(text):
    assert quality.counts((text or "").encode()) == brute_counts(text)


def corpus(rng):
    rows = []
    for doc in range(120):
        lang = rng.choice(["en", "de", None])
        stem = {"en": "the and of ing tion", "de": "der und sch ung ein", None: "la le que es os"}[lang].split()
        rows.append((doc, " ".join(rng.choice(stem) + rng.choice(stem) for _ in range(rng.randrange(5, 60))), lang))
    return rows + [(500, None, "en"), (501, "", "en"), (502, "zz## " * 40, "en"), (503, " ".join(f"QX{i}#*|" for i in range(60)), "en")]


def brute_model(texts):
    """Modified Kneser-Ney on strings, by its textbook definition."""
    runs = collections.Counter()
    for t in texts:
        s = " " + " ".join((t or "").split()) + " "
        s = "".join("0" if c.isdigit() else c for c in s)
        runs.update(s[i : i + 3] for i in range(len(s) - 2))
    levels = {3: runs}
    for n in (2, 1):
        levels[n] = collections.Counter(k[1:] for k in levels[n + 1])
    cuts = {}
    for n, c in levels.items():
        of = collections.Counter(c.values())
        y = of[1] / max(1, of[1] + 2 * of[2])
        cuts[n] = [max(0, k - (k + 1) * y * of[k + 1] / max(1, of[k])) for k in (1, 2, 3)]

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / 128
        mates = [v for k, v in levels[n].items() if k[:-1] == gram[:-1]]
        if not mates:
            return p(gram[1:])
        cut = lambda v: cuts[n][min(v, 3) - 1]
        own = levels[n].get(gram, 0)
        return ((own - cut(own) if own else 0) + sum(map(cut, mates)) * p(gram[1:])) / sum(mates)

    return p


def test_perplexities_equal_the_definition(spark):
    rows = corpus(random.Random(2))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = {r.doc_id: r.x for r in quality.scored(df).select("doc_id", F.col("__q__.log_perplexity").alias("x")).collect()}
    for lang in ("en", None):
        mine = [(d, t) for d, t, x in rows if x == lang]
        p = brute_model([t for _, t in mine])
        known = {}
        for doc, text in mine[:25] + mine[-4:]:
            s = "".join("0" if c.isdigit() else c for c in " " + " ".join((text or "").split()) + " ")
            grams = [s[i : i + 3] for i in range(len(s) - 2)]
            if not (text or "").split():
                assert got[doc] is None
                continue
            for g in set(grams) - set(known):
                known[g] = p(g)
            assert math.isclose(got[doc], -sum(math.log(known[g]) for g in grams) / len(grams), rel_tol=1e-4)


def test_unseen_runs_back_off(spark):
    rows = [(1, "aa ab", "en"), (2, "ab ba", "en")]
    model = quality.kneser_ney(quality.ngram_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).toPandas()
    p = brute_model([t for _, t, _ in rows])
    for text in (b"aab", b"zz", b"ab"):
        s = " " + text.decode() + " "
        wanted = -sum(math.log(p(s[i : i + 3])) for i in range(len(s) - 2)) / (len(s) - 2)
        assert math.isclose(-quality.Model(model).log_probabilities(quality.ngram_codes(text)).mean(), wanted, rel_tol=1e-4)


def test_verdicts(spark):
    rows = corpus(random.Random(3))
    rows.append((600, next(t for d, t, x in rows if x == "de" and len(t.split()) > 40), "en"))  # a wrong label
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, middle string")
    out = {r.doc_id: r for r in quality.judged(df, drop=("text",)).collect()}
    assert len(out) == len(rows) and out[0].middle == "clash"
    for doc, text, _ in rows:
        n, _, _, _, repeated = brute_counts(text)
        assert out[doc]["__failed__"] == (n < 20 or 100 * repeated > 30 * n)
        assert not (out[doc]["__failed__"] and out[doc]["__kept__"])
    assert out[502]["__failed__"] and not out[503]["__failed__"] and not out[503]["__kept__"]
    assert out[600]["__kept__"]
    clean = [out[d] for d, t, _ in rows if d < 500 and len((t or "").split()) >= 20]
    assert sum(r["__kept__"] for r in clean) >= 0.97 * len(clean)


def test_blocks_of_languages_and_empty_tables(spark, monkeypatch):
    rows = corpus(random.Random(4))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pick = lambda: {r.doc_id: r.x for r in quality.scored(df).select("doc_id", F.col("__q__.log_perplexity").alias("x")).collect()}
    whole = pick()
    monkeypatch.setattr(quality, "LANGUAGES_AT_ONCE", 1)
    assert pick() == whole
    assert quality.judged(df.limit(0)).count() == 0


def test_letters_of_any_script_are_told_apart(spark):
    """Runs are of characters, not of hashed classes, and as many as the texts hold."""
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)] + [chr(c) for c in range(0x400, 0x460)] + ["\U0001F600", "\x01"]
    texts = ["".join(letters[i : i + 40]) + " x9" for i in range(0, len(letters), 40)]
    df = spark.createDataFrame([(i, t, "zh") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    want = collections.Counter()
    for t in texts:
        s = f" {t[:-1]}0 "
        want.update(s[i : i + 3] for i in range(len(s) - 2))
    name = lambda code: "".join(chr(code >> shift & 0x1FFFFF) for shift in (42, 21, 0))
    counted = quality.ngram_counts(df)
    assert {name(r.code): r.n for r in counted.collect()} == want
    low = quality.kneser_ney(counted).filter("kind = 'b' and level = 0").first()
    assert math.isclose(low.p, 1 / (len({c for run in want for c in run[-1]} - {"9"}) + 1))


@pytest.mark.parametrize("alphabet", ["абвгдежз", "漢字仮名交文書"])
def test_other_scripts_equal_the_definition(spark, monkeypatch, alphabet):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choices(alphabet, k=3)) for _ in range(rng.randrange(1, 30))), rng.choice(["a", "b", "c"])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pick = lambda: {r.doc_id: (r.x, r.y) for r in quality.scored(df).select(
        "doc_id", F.col("__q__.log_perplexity").alias("x"), F.col("__q__.mixed").alias("y")).collect()}
    got = pick()
    models = {x: brute_model([t for _, t, lang in rows if lang == x]) for x in "abc"}
    for doc, text, lang in rows[:6]:
        grams = [f" {text} "[i : i + 3] for i in range(len(text))]
        assert math.isclose(got[doc][0], -sum(math.log(models[lang](g)) for g in grams) / len(grams), rel_tol=1e-6)
        assert math.isclose(got[doc][1], -sum(math.log(max(p(g) for p in models.values())) for g in grams) / len(grams), rel_tol=1e-6)
    monkeypatch.setattr(quality, "LANGUAGES_AT_ONCE", 1)
    monkeypatch.setattr(quality, "BLOCK_RUNS", 200)
    assert pick() == got
