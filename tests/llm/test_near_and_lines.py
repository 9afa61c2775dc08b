import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretrace.llm import hashing, lines, links, near


def union_find(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute_near(rows, n, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = union_find(len(rows), pairs)
    least = {}
    for (doc, _), r in zip(rows, root):
        least[r] = min(least.get(r, doc), doc)
    return sorted((doc, len(s), least[r], doc == least[r]) for (doc, _), s, r in zip(rows, sets, root))


def varied(rng, words, rate):
    return [rng.choice(["new", "other", str(rng.random())]) if rng.random() < rate else w for w in words]


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, docs, n, percent):
    rng = random.Random(2)
    rows = [(0, ""), (1, None), (2, "one"), (3, "One"), (4, "two words"), (5, "two words"), (6, " \n ")]
    for base in range(6):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(rng.choice([2, 3, 60])):
            rows.append((len(rows), " ".join(varied(rng, words, rng.choice([0, 0.01, 0.03, 0.06])))))
    rng.shuffle(rows)
    got = near.near_duplicates(docs(rows).repartition(4), n, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_near(rows, n, percent)


def test_missing_ids_repeated_rows_and_an_empty_table(spark, docs):
    text = "a b c d e f g"
    got = near.near_duplicates(docs([(None, text), (4, text), (4, text), (9, text), (None, "x y z"), (None, None)])).collect()
    by = sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str)
    assert by == sorted([(4, 4, True), (4, 4, True), (9, 4, False), (None, 4, False), (None, None, True), (None, None, True)], key=str)
    assert near.near_duplicates(docs([])).count() == 0


def test_components_of_long_paths_and_hubs(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    hub = [(7, 1000 + i) for i in range(50)] + [(1003, 3), (3, 3), (3, 1003)]
    edges = path + hub
    random.Random(1).shuffle(edges)
    got = {r.id: r.component for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 3 for i in [3, 7, *range(1000, 1050)]}}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("limit", [400_000, 11])
def test_components_of_edges_joined_in_tasks(spark, monkeypatch, limit):
    monkeypatch.setattr(links, "JOINED_ROWS", limit)
    rng, steps, kept = random.Random(7), [], links.keep
    monkeypatch.setattr(links, "keep", lambda df: steps.append(1) or kept(df))
    edges = [(i, i + 1) for i in range(60, 110)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(5, 5)]
    edges += edges[:20]
    rng.shuffle(edges)
    got = {r.id: r.component for r in links.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    root = union_find(400, edges)
    assert got == {x: root[x] for e in edges for x in e if e[0] != e[1]}
    assert limit < 100 or len(steps) <= 2


def test_texts_are_split_once(spark):
    df = spark.createDataFrame([(1, "a\nb\n\nc", [1, 3]), (2, "a\nb", [0, 1]), (3, "a\n", None), (4, None, None), (5, "", None)],
                               f"doc_id long, text string, {lines._MARK} array<int>")
    out = df.select("doc_id", lines._kept(F.col("text")).alias("text"), lines._n_lines(F.col("text")).alias("n")).collect()
    assert [(r.text, r.n) for r in out] == [("a\n", 4), ("", 2), ("a\n", 2), (None, 0), ("", 1)]
    # 40,000 lines: split anew for each, this took minutes
    long = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39_999)), lambda i: i.cast("string")), "\n").alias("text"),
                                 F.array(F.lit(0)).alias(lines._MARK))
    began = time.time()
    assert long.select(F.length(lines._kept(F.col("text")))).first()[0] == sum(len(str(i)) + 1 for i in range(1, 40_000)) - 1
    assert time.time() - began < 30


def test_a_task_signs_a_repeated_line_once(spark, docs):
    df = docs([(1, "the same line\nown line\nThe  same line"), (2, "the same line")]).coalesce(1)
    rows = sorted(((r.doc, r.line, r.id, len(r["keys"]), len(r.sig)) for r in lines.signed_lines(df).collect()))
    assert [(d, k, n, m) for d, k, _, n, m in rows] == [(1, 0, 12, 3), (1, 1, 12, 3), (1, 2, 0, 0), (2, 0, 0, 0)]
    assert rows[0][2] == rows[2][2] == rows[3][2] != rows[1][2]
    again = docs([(k, "the same line\n" * 6000) for k in range(2)]).coalesce(1)  # the second chunk has no new line
    assert lines.signed_lines(again).filter(F.size("keys") > 0).count() == 1


def test_packed_estimate_follows_similarity(spark):
    rng = np.random.default_rng(3)
    tool, both = hashing.MinHash(128), rng.integers(0, 1 << 63, 900).astype(np.uint64)
    for share in (0.0, 0.5, 0.9):
        cut = int(900 * share)
        other = np.r_[both[:cut], rng.integers(0, 1 << 63, 900 - cut).astype(np.uint64)]
        true = cut / (2 * 900 - cut)
        for bits in (1, 2, 4):
            a, b = (hashing.packed_bits(tool.minima(x), bits).tolist() for x in (both, other))
            row = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
            got = row.select(links.estimated(F.col("a"), F.col("b"), len(a), bits)).first()[0]
            assert abs(got - true) < 0.25


def test_runs_and_single_sets_have_the_same_minima():
    rng = np.random.default_rng(5)
    tool, x = hashing.MinHash(48, seed=4), rng.integers(0, 1 << 32, 500).astype(np.uint32)
    runs = tool.minima_of_runs(x, np.array([0, 3, 400]))
    for k, part in enumerate((x[:3], x[3:400], x[400:])):
        assert (runs[:, k] == tool.minima(part.astype(np.uint64))).all()


def brute_lines(rows, percent):
    place, sets = [], []
    for doc, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            flat = " ".join(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))
            if flat:
                place.append((doc, k))
                n = lines.SHINGLE
                sets.append({flat[i : i + n] for i in range(max(1, len(flat) - n + 1))})
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = union_find(len(sets), pairs)
    first = {}
    for p, r in zip(place, root):
        first[r] = min(first.get(r, p), p)
    gone = {p for p, r in zip(place, root) if first[r] != p}
    return sorted((doc, "\n".join(x for k, x in enumerate(t.split("\n")) if (doc, k) not in gone) if t is not None else None) for doc, t in rows)


def test_lines_equal_brute_force(spark, docs):
    rng = random.Random(8)
    texts = [" ".join(f"{rng.choice('abcdéfg')}{rng.randrange(90)}" for _ in range(rng.choice([1, 2, 12, 40]))) for _ in range(40)]
    rows = [(0, ""), (1, None), (2, "\n\n"), (3, " a \n"), (4, "A\n\nb")]
    for doc in range(5, 60):
        own = []
        for _ in range(rng.randrange(1, 7)):
            line = rng.choice(texts)
            own.append(rng.choice([line, line.upper() if line.isascii() else line, line.replace(" ", "  ", 1), line[:-1] + "x", line + " tail", ""]))
        rows.append((doc, "\n".join(own)))
    got = sorted((r.doc_id, r.text) for r in lines.deduplicated(docs(rows).repartition(3), 80).collect())
    assert got == brute_lines(rows, 80)


def test_lines_keep_columns_and_count(spark, docs):
    df = docs([(1, "same line here\nown"), (2, "same line here"), (None, "same line here"), (3, None)])
    out = lines.deduplicated(df)
    assert out.columns == df.columns and {r.doc_id: r.text for r in out.collect()} == {1: "same line here\nown", 2: "", None: "", 3: None}
    report = {r.doc_id: (r.n_lines, r.n_removed) for r in lines.line_report(df).collect()}
    assert report == {1: (2, 0), 2: (1, 1), None: (1, 1), 3: (0, 0)}
    assert lines.deduplicated(docs([])).count() == 0


def test_intersections_and_joining_links():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 40, 300).astype(np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, 250, replace=False), rng.integers(0, 1 << 40, 20).astype(np.uint64)]) for _ in range(70)]
    common = links.intersections(sets)
    assert all(common[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(70) for j in range(i + 1, 70))
    for n in (20, 70):
        found = links.joining_links(list(range(n)), list(range(n)), sets[:n], 70)
        pairs = [(i, j) for i in range(n) for j in range(i) if 100 * common[j, i] >= 70 * (len(sets[i]) + len(sets[j]) - common[j, i])]
        assert len(found) <= n - 1 and union_find(n, found) == union_find(n, pairs)


def test_large_clusters_are_compared_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(links, "BLOCK_ITEMS", 7)
    rng = random.Random(12)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(60):  # a chain of edits: few documents resemble the hubs, many their neighbours
        base = varied(rng, base, 0.02)
        rows.append((k, " ".join(base)))
    rng.shuffle(rows)
    got = near.near_duplicates(docs(rows), 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_near(rows, 3, 85)


@pytest.mark.parametrize("block", [4000, 9])
def test_similar_pairs_in_a_large_bucket_of_unlike_items(spark, monkeypatch, block):
    monkeypatch.setattr(links, "BUCKET_ITEMS", block, raising=False)
    rng, tool = np.random.default_rng(4), hashing.MinHash(128)
    sets = [np.unique(rng.integers(0, 1 << 40, 200)) for _ in range(60)]
    for k in range(0, 40, 4):  # pairs at 0.85 and a little above; few of them hold a hub
        sets[k + 1] = np.unique(np.r_[sets[k][: 200 - k // 4], rng.integers(0, 1 << 40, 15)])
    rows = [(k, [77], hashing.packed_bits(tool.minima(x.astype(np.uint64)), 2).tolist()) for k, x in enumerate(sets)]
    items = spark.createDataFrame(rows, "id long, keys array<long>, sig array<long>").repartition(3)
    texts = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(sets)], "id long, text binary")
    got = links.similar_components(items, 4, 2, 0.2, lambda _: texts, lambda t: np.frombuffer(t, np.int64), 85).collect()
    pairs = [(i, j) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    assert len(pairs) == 10 and sorted((r.id, r.component) for r in got) == sorted((x, min(p)) for p in pairs for x in p)


def test_estimates_of_arrays_equal_those_of_columns(spark):
    rng = np.random.default_rng(9)
    for bits in (1, 2, 4):
        sig = rng.integers(-(1 << 63), (1 << 63) - 1, (5, 3)) & rng.integers(-(1 << 63), (1 << 63) - 1, 3)
        got = {(k, k + 1 + at): x for k, row in links.estimates(sig.view(np.uint64), bits) for at, x in enumerate(row)}
        df = spark.createDataFrame([(i, j, sig[i].tolist(), sig[j].tolist()) for i, j in got], "i int, j int, a array<long>, b array<long>")
        for r in df.select("i", "j", links.estimated(F.col("a"), F.col("b"), 3, bits).alias("x")).collect():
            assert abs(got[r.i, r.j] - r.x) < 1e-12


def test_long_words_in_a_pattern_are_told_apart(spark, docs):
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    rows = [(1, f"{a} one two"), (2, f"{b} one two")]
    assert [(r.doc_id, r.component_id) for r in near.near_duplicates(docs(rows), n=3, percent=85).orderBy("doc_id").collect()] == [(1, 1), (2, 2)]


def test_sets_of_many_lines_are_the_sets_of_each():
    rng = random.Random(3)
    some = ["", "a", "abcdefgh", "é" * 9, "ab" * 40] + ["".join(rng.choices("abc \U0001F600", k=rng.randrange(1, 300))) for _ in range(200)]
    some = [x.encode() for x in some]
    got = lines.shingle_sets(some)
    assert len(got) == len(some) and all(np.array_equal(lines.shingle_set(x), y) for x, y in zip(some, got))
    assert lines.shingle_sets([]) == []
    for x, y in zip(got, got[1:]):
        assert links.n_common(x, y) == links.n_common(y, x) == len(np.intersect1d(x, y))


def test_only_items_with_a_shared_key_are_dealt(spark):
    keys = {k: [10_000 + k, 2000 + k // 2, 3000] if k < 10 else [10_000 + k] for k in range(2000)}
    rows = [(k, x, [k, -k]) for k, x in keys.items()] + [(5, [], []), (6, None, None)]
    items = spark.createDataFrame(rows, "id long, keys array<long>, sig array<long>")
    buckets, held = links.shared_buckets(items, 2)
    want = {(2000 + k // 2, k) for k in range(10)} | {(3000, k) for k in range(10)}
    got = buckets.collect()
    assert sorted((r.key, r.id) for r in got) == sorted(want)
    members = {key: {i for k, i in want if k == key} for key, _ in want}
    assert all(r.first == min(members[r.key]) and r.hub in members[r.key] for r in got)
    assert len({(r.key, r.hub) for r in got}) == len(members)
    sigs = {r.id: list(r.sig) for r in held.collect()}
    assert len(sigs) < 200 and all(sigs[k] == [k, -k] for k in range(10))
    again, _ = links.shared_buckets(items.union(items), 2)  # copies, as from several tasks
    assert {(r.key, r.id) for r in again.collect()} == want


def test_many_small_texts_are_verified_together(spark):
    rng = np.random.default_rng(8)
    tool = hashing.MinHash(128)
    sets = [np.unique(rng.integers(0, 1 << 40, 200)) for _ in range(40)]
    for k in range(0, 40, 2):
        sets[k + 1] = np.unique(np.r_[sets[k][:190], rng.integers(0, 1 << 40, 5 + k)])
    rows = [(k, [k // 2, 500 + k // 6], hashing.packed_bits(tool.minima(x.astype(np.uint64)), 2).tolist()) for k, x in enumerate(sets)]
    items = spark.createDataFrame(rows, "id long, keys array<long>, sig array<long>").repartition(3)
    texts = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(sets)], "id long, text binary")
    of = lambda t: np.frombuffer(t, np.int64)
    one, many = (sorted((r.id, r.component) for r in links.similar_components(items, 4, 2, 0.2, lambda _: texts, of, 85, sets_of).collect())
                 for sets_of in (None, lambda given: [of(t) for t in given]))
    pairs = [(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    assert pairs and one == many == sorted((x, min(p)) for p in pairs for x in p)


def test_large_clusters_are_cut_into_buckets(spark):
    """Each item of a large cluster is sent to its buckets of several components, not to every block of the cluster."""
    rows, keys = [], []
    for k in range(40):  # buckets of 4 items, every other one of a single component
        rows.append((k, 1, k // 4 if k // 4 % 2 else k, 6))
        keys.append((1000 + k // 4, k))
    for k in range(100, 106):  # a small cluster, and one that is a single bucket: they stay
        rows += [(k, 2, k, 1), (k + 100, 3, k, 5)]
        keys += [(2000, k), (3000, k + 100), (3001, k + 100)]
    left = spark.createDataFrame(rows, "id long, cluster long, component long, blocks int")
    got = links.by_bucket(left, spark.createDataFrame(keys, "key long, id long")).collect()
    assert sorted(tuple(r) for r in got if r.cluster in (2, 3)) == sorted(r for r in rows if r[1] in (2, 3))
    cut = [r for r in got if r.cluster not in (2, 3)]
    assert sorted(r.id for r in cut) == [k for k in range(40) if not k // 4 % 2]
    assert all(r.blocks == 1 and r.component == r.id for r in cut)
    assert len({r.cluster for r in cut}) == 5 and len({(r.cluster, r.id // 4) for r in cut}) == 5


def test_buckets_of_a_large_cluster_give_the_same_components(spark, monkeypatch):
    cut = []
    kept = links.by_bucket
    monkeypatch.setattr(links, "BLOCK_ITEMS", 8)
    monkeypatch.setattr(links, "by_bucket", lambda left, buckets: cut.append(kept(left, buckets)) or cut[0])
    rng = np.random.default_rng(12)
    tool, base = hashing.MinHash(128), np.unique(rng.integers(0, 1 << 40, 300))
    sets = [np.unique(np.r_[base[:150], rng.integers(0, 1 << 40, 150)]) for _ in range(60)]  # alike, but no links
    for k in range(0, 60, 3):
        sets[k + 1] = np.unique(np.r_[sets[k][:285], rng.integers(0, 1 << 40, 5)])
        sets[k + 2] = np.unique(np.r_[sets[k + 1][:285], rng.integers(0, 1 << 40, 5)])
    rows = [(k, [k // 6, 100 + k // 3, 500], hashing.packed_bits(tool.minima(x.astype(np.uint64)), 2).tolist()) for k, x in enumerate(sets)]
    rows = [(k, keys[:2] if k % 3 else keys, sig) for k, keys, sig in rows]
    items = spark.createDataFrame(rows, "id long, keys array<long>, sig array<long>").repartition(3)
    texts = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(sets)], "id long, text binary")
    got = links.similar_components(items, 4, 2, 0.2, lambda _: texts, lambda t: np.frombuffer(t, np.int64), 85).collect()
    pairs = [(i, j) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    root = union_find(60, pairs)
    assert pairs and sorted((r.id, r.component) for r in got) == sorted((k, root[k]) for k in {x for p in pairs for x in p})
    assert cut[0].agg(F.max("blocks")).first()[0] <= 4


def test_minima_of_lines_in_place_are_those_of_their_shingles():
    rng, tool = random.Random(5), lines._tools()[1]
    for some in (["a"], ["abcdefgh"], ["abcdefg", "b", "x" * 9, "é\U0001F600" * 4], ["".join(rng.choices("abc é\U0001F600", k=rng.randrange(1, 40))) for _ in range(200)]):
        own = lines._Lines(some)
        for new in (np.ones(len(some), bool), np.arange(len(some)) % 2 == 0):
            hashes, runs = own.shingles(new)
            assert np.array_equal(tool.minima_of_runs((hashes >> np.uint64(32)).astype(np.uint32), runs), tool.minima_of_spans(*own.upper_halves(new)))
