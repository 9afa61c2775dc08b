import random

import numpy as np
import pytest

from foretrace.llm import decontam


def brute_alignment(item, passage):
    table = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i, x in enumerate(item, 1):
        for j, y in enumerate(passage, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if x == y else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
    return best


def test_alignment_equals_the_full_table():
    rng = random.Random(4)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        assert decontam.alignment(np.array(a), np.array(b))[0] == brute_alignment(a, b)


@pytest.fixture
def items(spark):
    rng = random.Random(1)
    texts = [" ".join(f"i{k}w{rng.randrange(50)}" for _ in range(40)) for k in range(4)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(10, None), (11, ""), (12, "Two words"), (13, texts[0])]
    return texts, spark.createDataFrame(rows, "item_id long, text string")


def test_exact_edited_and_shortened_copies_are_found(spark, docs, items):
    texts, table = items
    rng = random.Random(3)
    noise = lambda n: " ".join(f"n{rng.randrange(10**6)}" for _ in range(n))
    edited = " ".join(noise(1) if k % 6 == 5 else w for k, w in enumerate(texts[1].split()))
    dropped = " ".join(w for k, w in enumerate(texts[2].split()) if k % 7)
    rows = [(1, noise(80) + ", " + texts[0].upper() + "! " + noise(50)), (2, noise(30) + " " + edited), (3, dropped + " " + noise(500)),
            (4, noise(200)), (5, None), (6, ""), (7, noise(5) + " two. WORDS " + noise(5)), (8, " ".join(texts[3].split()[:8]) + " " + noise(40)), (None, texts[3])]
    got = decontam.contaminated(docs(rows).repartition(3), table).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted([(1, 0), (1, 13), (2, 1), (3, 2), (7, 12), (None, 3)], key=str)
    exact = next(r for r in got if (r.doc_id, r.item_id) == (1, 0))
    assert (exact.share, exact.first_word, exact.end_word) == (1.0, 80, 120)
    kept = decontam.clean(docs(rows), table)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 8] and kept.columns == docs(rows).columns


def test_shares_equal_brute_force_over_whole_texts(spark, docs, items):
    texts, table = items
    rng = random.Random(6)
    rows = []
    for doc in range(40):
        words = rng.choice(texts).split()
        cut = [w for w in words if rng.random() > 0.15]
        rows.append((doc, " ".join(["x"] * rng.randrange(60) + cut + [f"y{rng.randrange(9)}"] * rng.randrange(60))))
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(docs(rows), table, least=0.3).collect()}
    wanted = {}
    for doc, text in rows:
        for k, item in [*enumerate(texts), (13, texts[0])]:
            score = brute_alignment(item.split(), text.split())
            if score >= 0.3 * 2 * 40:
                wanted[doc, k] = score
    assert got == wanted


def test_an_edited_copy_is_found_beside_full_and_other_copies(spark, docs):
    words = [f"w{k}" for k in range(22)]
    edited = [f"x{k}" if k in (10, 13, 16, 19) else w for k, w in enumerate(words)]
    other = [f"y{k}" if k in (3, 6) else w for k, w in enumerate(words)]
    table = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    # The edited copy keeps eight of twenty seeds, all of them also in the full copy.
    rows = [(1, "a " + " ".join(words) + " b"), (2, "c " + " ".join(edited) + " d"), (3, "e " + " ".join(other)), (4, "w0 w1 w2 " + "z " * 40)]
    for kept in ([0, 1, 3], [0, 1, 2, 3]):
        found = decontam.contaminated(docs([rows[k] for k in kept]), table).collect()
        assert {r.doc_id: r.score for r in found} == {rows[k][0]: brute_alignment(words, rows[k][1].split()) for k in kept if k < 3}
        assert [r.doc_id for r in decontam.clean(docs([rows[k] for k in kept]), table).collect()] == [4]


def test_no_score_exceeds_its_bound():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.randrange(9) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        assert decontam.bound(np.isin(b, a)) >= brute_alignment(a, b)


def test_copies_in_every_document_and_in_blocks(spark, docs, items, monkeypatch):
    texts, table = items
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)
    rows = [(k, f"a{k} " + texts[1]) for k in range(30)]
    got = decontam.contaminated(docs(rows), table).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, 1) for k in range(30)]


def test_empty_tables(spark, docs, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(docs([(1, "a b c d")]), none).count() == 0
    assert decontam.clean(docs([(1, "a b c d")]), none).count() == 1
    assert decontam.contaminated(docs([]), items[1]).count() == 0
