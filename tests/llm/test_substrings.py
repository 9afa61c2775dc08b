import hashlib
import random
import re

import pandas as pd
import pytest

from foretrace.llm import sketches, substrings


def brute(rows, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, float("inf")), float("inf") if i is None else i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (float("inf") if i is None else i):
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def ours(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("window", [1, 6, 50])
def test_equals_brute_force(spark, docs, window):
    rng = random.Random(5)
    base = [rng.choice("ab cd ef gh ijé kl, mn".split()) + str(rng.randrange(40)) for _ in range(400)]
    rows = [(None, None), (3, ""), (4, " \t\n"), (5, "one"), (None, " ".join(base[:90]))]
    for i in range(40):
        a = rng.randrange(300)
        part = base[a : a + rng.randrange(100)] + [str(rng.random()) for _ in range(rng.randrange(8))] + base[:60] * (i % 3)
        rows.append((rng.randrange(30), "  ".join(part) + "\n"))
    rows += rows[-3:] + [(7, "w " * 300), (8, "w " * 200)]
    df = docs(rows).repartition(5)
    assert ours(substrings.deduplicated(df, window)) == brute(rows, window)


def test_flushed_parts_give_the_same(spark, docs, monkeypatch):
    rows = [(i, " ".join(f"{k % 97}x{i % 3}" for k in range(300))) for i in range(30)]
    monkeypatch.setattr(substrings, "FLUSH", 100)
    assert ours(substrings.deduplicated(docs(rows), 20, texts=False)) == brute(rows, 20)


def test_spans_and_texts(spark, docs):
    common = " ".join(f"c{k}" for k in range(60))
    out = {r.doc_id: r for r in substrings.deduplicated(docs([(1, common), (2, "start\n" + common + " end")]), 50).collect()}
    assert (out[1].n_removed, out[1].spans) == (0, [])
    assert out[2].kept_text == "start end" and [(s.start, s.end) for s in out[2].spans] == [(1, 61)]


def test_empty_table(spark, docs):
    assert substrings.deduplicated(docs([]), 50).count() == 0


def test_cells_follow_the_input():
    size = lambda n: sketches.cell_bits(substrings.expected_anchors(n, 50))
    assert size(0) == 20 and size(10**9) > size(10**8) and size(10**14) == 30


def test_coverage():
    assert substrings.covered(6, pd.Series([1, 2]).to_numpy(), 2).tolist() == [False, True, True, True, False, False]


def thue_morse(a, b, rounds=10):
    x, y = a, b
    for _ in range(rounds):
        x, y = x + y, y + x
    return x, y


def test_patterns_that_polynomials_confuse(spark, docs):
    """Words of 1,024 letters, and sequences of words, in a pattern and its complement."""
    long_a, long_b = thue_morse("a", "b")
    rest = [f"w{k}" for k in range(49)]
    words_a, words_b = thue_morse(["x"], ["y"], 5)
    rows = [(1, " ".join([long_a, *rest])), (2, " ".join([long_b, *rest])), (3, " ".join(words_a + rest)), (4, " ".join(words_b + rest[:18] + ["z"]))]
    assert [r.n_removed for r in substrings.deduplicated(docs(rows)).orderBy("doc_id").collect()] == [0, 0, 0, 0]


def test_sequence_hashes_depend_on_order_and_length():
    from foretrace.llm import hashing

    words = hashing.word_hashes([b"a", b"b", b"a", b"b", b"c"] * 20)
    for n in (1, 2, 3, 5, 8, 50):
        for which in (0, 1):
            found = hashing.sequence_hashes(words[:, which], n, which)
            assert len(found) == 100 - n + 1 and len(set(found.tolist())) == 5 if n > 2 else True
    texts = ["a b c", "c b a", "a b", "b a", "a", "a a", "a a a"]
    assert len({int(hashing.shingle_hashes(t.encode(), 9)[0]) for t in texts}) == len(texts)
