import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from foretrace.llm import runs, spelling, trie
from foretrace.llm.queries import QUERIES, tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTES = "byte_bpe_50k.json"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_runs(w, at_least=6, times=4):
    found = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            smaller = any(all(w[x] == w[x + p] for x in range(start, start + length - p)) for p in range(1, q))
            if length >= max(at_least, times * q) and not smaller:
                found.append((start, length, q))
            i = max(i, start + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rng, letters):
    words = [rng.choice(letters) for _ in range(rng.randrange(60))]
    if words and rng.random() < 0.7:
        words += words[: rng.randrange(1, 9)] * rng.randrange(1, 9) + words[:3]
    return words


@pytest.mark.parametrize("letters", ["a", "ab", "abc"])
def test_runs_equal_brute_force(letters):
    rng = random.Random(3)
    for _ in range(400):
        documents = [[w.encode() for w in random_words(rng, letters)] for _ in range(rng.randrange(1, 4))]
        expected, begun = [], 0
        for words in documents:
            expected += [[start + begun, length, q] for start, length, q in brute_runs(words)]
            begun += len(words)
        found = runs.periodic_runs(runs.word_numbers(documents))
        assert found.tolist() == sorted(expected, key=lambda r: (r[0], r[2]))


def test_long_run_and_large_period():
    assert runs.periodic_runs(np.zeros(300_000, np.int64)).tolist() == [[0, 300_000, 1]]
    assert runs.periodic_runs(np.tile(np.arange(5_000), 5)[:-7]).tolist() == [[0, 24_993, 5_000]]
    assert len(runs.periodic_runs(np.arange(50_000))) == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(np.zeros(9, np.int64), times=3)


def expected_op11(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute_runs(w)
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op11_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(None, None), (None, "a a a a a a a"), (1, ""), (2, " \t\n"), (3, "é"), (3, "é")]
    rows += [(i, rng.choice([" ", "  ", "\n"]).join(random_words(rng, ["ab", "cd,", "ÉF", "gh"]))) for i in range(100, 260)]
    spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, runs int, n_words string").write.parquet(
        str(tmp_path / "documents.parquet"))
    got = QUERIES["op11_basic_factor_runs"](spark, str(tmp_path)).collect()
    ours = [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got]
    assert sorted(ours, key=str) == sorted((expected_op11(*r) for r in rows), key=str)
    assert sum(r.n_runs for r in got) > 50


def test_runs_of_an_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert runs.runs_collapsed(empty).collect() == []
    clash = spark.createDataFrame([("x", "a b a b a b a b c", 1)], "key string, body string, collapsed int")
    assert [tuple(r) for r in runs.runs_collapsed(clash, id="key", text="body").collect()] == [("x", 9, [(0, 8, 2)], "a b c")]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(BYTES))


def odd_texts():
    rng = random.Random(4)
    letters = "aeiou thenrs  \n\t'sdll12é中文…\x1c\x85 !?.  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(70))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x10000, 0x1F9FF)])) for _ in range(30)) for _ in range(300)]
    return texts + ["", " ", "  ", "\n ", "a\n ", "x  y\n\n  z ", "<|endoftext|>", "a <|endoftext|>  <|endoftext|> b", "a" * 3000, "ab" * 2000, "1" * 999]


def test_trie_equals_the_library(library):
    texts = odd_texts()
    ours = trie.Encoder(tokenizer(BYTES))
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(f, "<i4").tolist() for f in ours.encode(texts)] == expected
    assert [np.frombuffer(f, "<i4").tolist() for f in ours.encode(texts)] == expected  # from the tables


def test_bounded_tables_change_nothing(library):
    texts = odd_texts()[:400]
    ours = trie.Encoder(tokenizer(BYTES), limit=50)
    ours.trie.limit = 30
    found = [np.frombuffer(f, "<i4").tolist() for k in range(0, 400, 20) for f in ours.encode(texts[k : k + 20])]
    assert found == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_token_stays_as_it_is(library):
    ours = trie.Encoder(tokenizer(BYTES))
    assert ours.trie.reached == set(library.get_vocab(with_added_tokens=False).values())


def test_op12_equals_the_library(spark, library, tmp_path):
    rows = [(None, None), (None, "x y"), (1, ""), (2, "same"), (2, "same")] + [(10 + i, t) for i, t in enumerate(odd_texts()[::7])]
    spark.createDataFrame([(i, t, [3]) for i, t in rows], "doc_id long, text string, ids array<int>").write.parquet(
        str(tmp_path / "documents.parquet"))
    expected = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = QUERIES["op12_prefix_trie_bpe"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(expected, key=str)


def test_decoding_null_ids_and_empty_tables(spark):
    tokens = spark.createDataFrame([(1, None), (2, []), (3, [50256, 64])], "doc_id long, ids array<int>")
    assert [r.text for r in trie.decoded(tokens, tokenizer(BYTES)).orderBy("doc_id").collect()] == ["", "", "<|endoftext|>a"]
    assert trie.decoded(trie.encoded(spark.createDataFrame([], "doc_id long, text string"), tokenizer(BYTES)), tokenizer(BYTES)).collect() == []


def edited_once(word):
    letters = spelling.LETTERS
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return out - {word}


def brute_groups(n, at_least=3, letters=5):
    n = {w: k for w, k in n.items() if k >= at_least and len(w) >= letters}
    near = {w: [x for x in edited_once(w) if x in n] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def random_counts(rng, size):
    stems = ["".join(rng.choice("abcdéÿ") for _ in range(rng.randrange(5, 9))) for _ in range(size)]
    found = {}
    for w in stems:
        found[w] = rng.randrange(3, 2000)
        for _ in range(6):
            w = rng.choice(sorted(edited_once(w)))
            found.setdefault(w, rng.randrange(1, 40))
    return {w: k for w, k in found.items() if w}


@pytest.mark.parametrize("symbols", [(1,), (6,), (6, 90), spelling.SYMBOLS])
def test_near_words_equal_brute_force(spark, symbols):
    n = {w: k for w, k in random_counts(random.Random(2), 60).items()}
    n["z" * 700] = n["z" * 701] = n["z" * 350 + "é" + "z" * 349] = 4
    pairs = spelling.near_words(spark.createDataFrame(sorted(n.items()), "word string, n long"), symbols, crowded=2)
    got = [tuple(r) for r in pairs.collect()]
    expected = [(w, n[w], x, n[x]) for w in n for x in edited_once(w) if x in n]
    assert sorted(got) == sorted(expected) and len(got) == len(set(got))


def test_no_table_of_words_or_neighbours_is_broadcast(spark):
    """Spark sees the size of the words in their file, and of the neighbours only that of the words."""
    counts = spark.createDataFrame(sorted(random_counts(random.Random(4), 20).items()), "word string, n long")
    for found in (spelling.near_words(counts), spelling.spelling_groups(counts)):
        assert found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_groups_follow_long_chains(spark):
    chain = {"aaaaa" + "b" * k: 3 * 2 ** (19 - k) for k in range(20)}
    n = random_counts(random.Random(6), 40) | chain
    got = rows_of(spelling.spelling_groups(spark.createDataFrame(sorted(n.items()), "word string, n long")))
    assert got == brute_groups(n)
    assert {r[2] for r in got if r[0] in chain} == {"aaaaa"}


def test_op13_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = [w for w in random_counts(rng, 25)]
    rows = [(None, None), (None, "Maison maison MAISON maisom"), (1, ""), (2, "12 .. 中"), (3, "ÀÉÎÕÜ ÀÉÎÕÜ àéîõü ×÷×÷× ×÷×÷×"), (3, "ÀÉÎÕÜ ×÷×÷×")]
    rows += [(i, " ".join(rng.choice(vocabulary)[: rng.randrange(2, 12)].title() + rng.choice(["", ".", "-x", "1"]) for _ in range(60)))
             for i in range(10, 300)]
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").write.parquet(
        str(tmp_path / "documents.parquet"))
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    got = rows_of(QUERIES["op13_reduced_alphabet_variants"](spark, str(tmp_path)))
    assert got == brute_groups(n)
    assert sum(r[1] is not None for r in got) > 5


def test_spelling_of_an_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
