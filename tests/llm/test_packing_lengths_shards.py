import collections
import random
import zlib

import numpy as np
import pytest

from foretrace.llm import lengths, packing, shards, tokens
from foretrace.llm.queries import tokenizer

TEXTS = [None, "", " ", "Don't stop, THE end!! <|endoftext|> ñandú Σ 中文 a\x1cb", "w " * 3000, "Hello there", "Hello there"]


def whole(text):
    return tokens.word_ids(tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture
def table(docs):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeéñß,.'") for _ in range(rng.randrange(1, 9)))
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (6, "Hello there")]
    rows += [(100 + k, " ".join(word() for _ in range(rng.choice([3, 40, 400])))) for k in range(60)]
    return rows, docs(rows).repartition(3)


def test_words_encode_as_whole_texts(table):
    coder = tokens.WordIds(tokenizer(), limit=50)
    for _, text in table[0]:
        assert np.frombuffer(coder.ids((text or "").encode()), "<u4").tolist() == whole(text)


def test_packing(spark, table):
    rows, df = table
    out = packing.packed_documents(df, tokenizer(), 256).collect()
    by_doc = collections.defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
    for doc, text in rows:
        if sum(d == doc for d, _ in rows) == 1:
            ids = np.array([*whole(text), 0], "<u4")
            got = sorted(by_doc[doc], key=lambda r: r.piece)
            assert [(r.piece, r.start, r.length, r.ids_crc32) for r in got] == [
                (k, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())) for k, a in enumerate(range(0, len(ids), 256))]
    assert len(by_doc[6]) == 2
    places = collections.defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 256
    gaps = []
    for n in sorted((r.length for r in out), reverse=True):  # best fit, longest first
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else 256) - n)
    assert len(places) <= len(gaps) + 1
    assert packing.packed_documents(df.limit(0), tokenizer()).count() == 0


def test_groups_of_pieces(spark, table):
    pieces = packing.encoded_pieces(table[1], tokenizer(), 256)
    assert packing.pack(pieces, 256, group_pieces=10).count() == pieces.count()


def test_sum_of_squares_takes_the_smallest_sum():
    rng = random.Random(2)
    sizes = np.array([rng.randrange(1, 21) for _ in range(300)])
    sequence, offset, used = packing.sum_of_squares(sizes, 20)
    fill = [0] * used
    for k, s in enumerate(sizes.tolist()):
        def total(b):
            after = [f + s if i == b else f for i, f in enumerate(fill)]
            return sum(n * n for n in collections.Counter(20 - f for f in after if 0 < f < 20).values())
        fits = [b for b in range(used) if 0 < fill[b] <= 20 - s] + ([fill.index(0)] if 0 in fill else [])
        assert offset[k] == fill[sequence[k]] and total(sequence[k]) == min(map(total, fits))
        fill[sequence[k]] += s


def test_length_report(spark, table):
    rows, df = table
    n = sorted(len(whole(t)) for _, t in rows)
    hist = lengths.histogram(lengths.encoded_lengths(df, tokenizer()))
    report = {r.n_tokens: r for r in lengths.length_report(hist, band=16).collect()}
    assert set(report) == set(n)
    for limit, r in report.items():
        assert (r.n_docs, r.docs_over, r.docs_within) == (n.count(limit), sum(x > limit for x in n), sum(x <= limit for x in n))
        assert (r.tokens_over, r.truncated_tokens) == (sum(x for x in n if x > limit), sum(min(x, limit) for x in n))
        assert r.total_tokens == sum(n) and r.lost_tokens == r.total_tokens - r.truncated_tokens
    asked = {r.context_limit: r.truncated_tokens for r in lengths.context_limits(hist, [0, 7, 10**6]).collect()}
    assert asked == {k: sum(min(x, k) for x in n) for k in asked} and len(asked) == 3
    got = {r.share: r.n_tokens for r in lengths.quantiles(lengths.length_report(hist), [0.5, 1.0]).collect()}
    assert got == {0.5: next(x for x in n if sum(y <= x for y in n) >= 0.5 * len(n)), 1.0: n[-1]}
    assert lengths.length_report(hist.limit(0)).count() == 0


def test_texts_are_encoded_once_for_a_report(spark):
    met = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            met.add(len(batch))
            yield batch

    counted = spark.range(40).selectExpr("id % 3 AS n_tokens").mapInPandas(count, "n_tokens long")
    report = lengths.length_report(lengths.histogram(counted)).orderBy("n_tokens").collect()
    assert [(r.n_tokens, r.n_docs, r.docs_over) for r in report] == [(0, 14, 26), (1, 13, 13), (2, 13, 0)]
    assert met.value == 40


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_permutation_and_its_inverse(n):
    image = shards.permuted(np.arange(n), n, 3)
    assert sorted(image.tolist()) == list(range(n)) and (shards.permuted(image, n, 3, inverse=True) == np.arange(n)).all()
    assert n < 64 or (image != np.arange(n)).any()


def test_sharding(spark, table):
    rows, df = table
    out = shards.sharded_documents(df, 7, seed=5).collect()
    assert sorted((r.size, r.text_crc32) for r in out) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert shards.shard_of(r.row_number, len(rows), 7, 5) == (r.shard, r.slot)
        assert shards.row_at(r.shard, r.slot, len(rows), 7, 5) == r.row_number
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = shards.sharded_documents(df.repartition(5), 7, seed=5).collect()
    key = lambda r: (r.shard, r.slot, r.size, r.text_crc32)
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert shards.sharded_documents(df.limit(0), 7).count() == 0
