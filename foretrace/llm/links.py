"""Links between similar sets, from MinHash bands to components, without all pairs of a bucket.

Items that share a band key form a bucket. Each item is paired with two hubs of each of its
buckets; pairs that their packed signatures call unlike are dropped, and the rest join items into
clusters. Where a bucket holds items of several clusters, the signatures of these are compared with
each other in blocks, and clusters with a pair that may be similar become one, so that any two
similar items with a common bucket are in one cluster. A first round
verifies each item with the hub most like it, and what that links falls into components. Where a
cluster still holds several components, its items are compared in blocks, those of a large one bucket by
bucket: exact intersections
from an inverted list, of which only links that join two components leave the task. A group
of copies costs one pair for each of its items; nothing is emitted for pairs that are not links.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.llm.sketches import Bits, cell_bits, count_min
from foretrace.llm.store import keep

MAX_STEPS = 60
BLOCK_ITEMS = 1500
WHOLE_BLOCKS = 4  # a cluster of more blocks is compared bucket by bucket
BUCKET_ITEMS = 4000
EDGE_ROWS = 250_000
JOINED_ROWS = 400_000
SET_BYTES = 1 << 18  # of texts whose sets are made at a time


def _dealt(edges: DataFrame, n: int) -> DataFrame:
    return edges.repartition(n, "a")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (id, smallest id that these edges reach from it) that join what these edges join."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if not (apart := low < high).any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    led = root < np.arange(len(ids))
    return ids[led], ids[root[led]]


def _joined(edges: DataFrame, limit: int) -> DataFrame:
    """Edges that join the same ids, fewer where those of a partition have circles: ``limit`` edges or
    little more at a time become stars."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append((batch.column("a").to_numpy(zero_copy_only=False), batch.column("b").to_numpy(zero_copy_only=False)))
            size += batch.num_rows
            if size > limit:
                held, size = [stars(*map(np.concatenate, zip(*held)))], 0
                yield pa.RecordBatch.from_arrays(list(map(pa.array, held.pop())), names=["a", "b"])
        if size:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, stars(*map(np.concatenate, zip(*held))))), names=["a", "b"])

    return edges.mapInArrow(join, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every end of the links (a, b).

    First the edges of each partition become stars, and those of some partitions together, while that
    leaves fewer. If all that is left fits in JOINED_ROWS, these are the components. Otherwise
    alternating stars: each id takes its larger neighbours to the smallest one, then its
    smaller ones, until every id points at the smallest of its component. Smallest
    neighbours come from partial aggregates; the table is written between the steps."""
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    edges = keep(_joined(pairs, JOINED_ROWS))
    n, whole = edges.count(), False
    while n and not whole:
        whole, before = n <= JOINED_ROWS, n
        edges = keep(_joined(edges.coalesce(1 + 2 * n // JOINED_ROWS if not whole else 1), JOINED_ROWS))
        n = edges.count()
        if n > 0.8 * before:
            break
    if not whole and n:
        edges = _alternated(keep(edges.distinct()))
    roots = edges.select(F.col("b").alias("id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select("id", F.col("id").alias("component")))


def _alternated(edges: DataFrame) -> DataFrame:
    mark = (edges.count(), None)
    for _ in range(MAX_STEPS):
        # As many tasks as the edges need, not as the session has partitions: the steps are many and
        # the table shrinks. Everything of a step that groups or joins by one end keeps that dealing.
        dealt = functools.partial(_dealt, n=1 + 2 * mark[0] // EDGE_ROWS)
        both = dealt(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = dealt(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(least, "a").filter("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b")).union(least.toDF("a", "b"))
        edges = keep(dealt(small).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return edges


def matching_lanes(a: Column, b: Column, words: int, bits: int) -> Column:
    """How many ``bits`` wide lanes (1, 2 or 4) of two packed signatures agree."""
    lane = {1: -1, 2: 0x5555555555555555, 4: 0x1111111111111111}[bits]
    off = None
    for k in range(words):
        x = a[k].bitwiseXOR(b[k])
        for shift in (1, 2)[: bits.bit_length() - 1]:
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        n = F.bit_count(x.bitwiseAND(F.lit(lane)))
        off = n if off is None else off + n
    return F.lit(words * (64 // bits)) - off


def estimated(a: Column, b: Column, words: int, bits: int) -> Column:
    """Similarity from packed signatures: equal lanes, corrected for those equal by chance."""
    chance = 0.5**bits
    return (matching_lanes(a, b, words, bits) / F.lit(float(words * (64 // bits))) - chance) / (1 - chance)


def shared_buckets(items: DataFrame, words: int, flush: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(key, id, hub, first) of the band keys that two or more items have, and (id, sig) of at least the items
    that have one. A count-min sketch of all keys drops most keys of a single item, and the items that
    have no others, before anything is shuffled."""
    spark = items.sparkSession
    size = items.agg(F.sum(F.size("keys").cast("long"))).first()[0] or 0
    flat = lambda batch: batch.column("keys").flatten().to_numpy(zero_copy_only=False)
    known = spark.sparkContext.broadcast(count_min(
        items.select("keys"), lambda batch: iter([flat(batch).view(np.uint64)]), cell_bits(size / 2), flush=flush, arrow=True))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pc.fill_null(pc.list_value_length(batch.column("keys")), 0).to_numpy(zero_copy_only=False)
            keys = flat(batch)
            hit = known.value.hit(keys)
            hits = np.bincount(np.repeat(np.arange(len(n)), n)[hit], minlength=len(n))
            own = pa.array(np.flatnonzero(hits))
            ends = np.r_[0, np.cumsum(hits[hits > 0])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(own), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[hit])),
                                              batch.column("sig").take(own)], names=["id", "keys", "sig"])

    # Copies of an item in several tasks hit the same keys. A group's buffer holds words only, no arrays.
    held = items.select("id", "keys", "sig").mapInArrow(some, "id long, keys array<long>, sig array<long>")
    parts = [F.first(F.col("sig")[k]).alias(f"w{k}") for k in range(words)]
    held = keep(held.groupBy("id", "keys").agg(*parts).select("id", "keys", F.array(*[f"w{k}" for k in range(words)]).alias("sig")))
    found = held.select(F.explode("keys").alias("key"), "id")
    # Two hubs: the smallest in an order drawn for the key, and the smallest id.
    drawn = F.col("id").bitwiseXOR(F.col("key"))
    hubs = found.groupBy("key").agg(F.min(drawn).alias("_h"), F.min("id").alias("first"), F.max("id").alias("_l")).filter(
        F.col("first") < F.col("_l")).select("key", F.col("_h").bitwiseXOR(F.col("key")).alias("hub"), "first")
    return keep(found.join(hubs.hint("shuffle_hash"), "key")), held.select("id", "sig")


def ids_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()


def id_bits(ids: DataFrame) -> Bits:
    """A filter of fixed size that lets through every one of the ids and few others."""
    n = ids.count()
    return count_min(ids.select("id"), lambda batch: iter([batch["id"].to_numpy(np.int64).view(np.uint64)]), cell_bits(n), level=1)


def n_common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(x) < len(y):
        x, y = y, x
    if not len(y):
        return 0
    at = x.searchsorted(y)
    at[at == len(x)] = 0
    return int(np.count_nonzero(x[at] == y))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted distinct arrays. Rare members are counted
    through their lists, frequent ones, and all of small sets, by matrix products over a few thousand members at a time."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, member, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(member, kind="stable")
    lists = owner[order]  # ascending within a member
    starts = np.cumsum(times) - times
    out = np.zeros((n, n), np.int64)
    rare = 32 if len(owner) > 50_000 else 1
    for k in range(2, min(rare, n) + 1):
        at = starts[times == k]
        if len(at):
            table = lists[at[:, None] + np.arange(k)]
            for x in range(k):
                for y in range(x + 1, k):
                    np.add.at(out, (table[:, x], table[:, y]), 1)
    often = np.flatnonzero(times > rare)
    place = np.full(len(times), -1)
    for at in range(0, len(often), 2048):
        part = often[at : at + 2048]
        place[part] = np.arange(len(part))
        cells = place[member]
        dense = np.zeros((n, len(part)), np.float32)
        dense[owner[cells >= 0], cells[cells >= 0]] = 1
        out += np.triu(dense @ dense.T, 1).astype(np.int64)
        place[part] = -1
    return out


def joining_links(ids: list[int], labels: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among the items that join different components; enough of them to join all that
    any link joins, and no more."""
    root = {c: c for c in labels}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    found = []

    def join(x: int, y: int) -> None:
        a, b = find(labels[x]), find(labels[y])
        if a != b:
            root[a] = b
            found.append((min(ids[x], ids[y]), max(ids[x], ids[y])))

    size = np.array([len(x) for x in sets], np.int64)
    if len(ids) <= 24:
        for x in range(len(ids)):
            for y in range(x):
                if find(labels[x]) != find(labels[y]) and 100 * min(size[x], size[y]) >= percent * max(size[x], size[y]):
                    common = n_common(sets[x], sets[y])
                    if 100 * common >= percent * (size[x] + size[y] - common) > 0:
                        join(x, y)
        return found
    common = intersections(sets)
    whole = size[:, None] + size[None, :] - common
    for x, y in np.argwhere(np.triu((100 * common >= percent * whole) & (whole > 0), 1)):
        join(int(x), int(y))
    return found


def least_estimate(lanes: int, bits: int, percent: int) -> float:
    """Six standard errors below the threshold: a linked pair is estimated lower once in a billion."""
    chance, p = 0.5**bits, percent / 100
    equal = chance + (1 - chance) * p
    return p - 6 * (equal * (1 - equal) / lanes) ** 0.5 / (1 - chance)


def estimates(sig: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of packed signatures, ``estimated`` of it and each later row."""
    lane = np.uint64({1: 0xFFFFFFFFFFFFFFFF, 2: 0x5555555555555555, 4: 0x1111111111111111}[bits])
    lanes, chance = sig.shape[1] * (64 // bits), 0.5**bits
    for k in range(len(sig) - 1):
        x = sig[k + 1 :] ^ sig[k]
        for shift in (1, 2)[: bits.bit_length() - 1]:
            x |= x >> np.uint64(shift)
        off = np.bitwise_count(x & lane).sum(axis=1, dtype=np.int64)
        yield k, ((lanes - off) / lanes - chance) / (1 - chance)


def bridges(buckets: DataFrame, clusters: DataFrame, signs: DataFrame, words: int, bits: int, least: float) -> DataFrame:
    """a, b, like, a_cluster, b_cluster: pairs of items that share a bucket, lie in different clusters and
    are estimated ``least`` or more; for each block of a bucket, enough of them to join the clusters that
    any such pair joins. Hubs have met all items of their bucket before. A pair of blocks is a task."""
    rest = keep(buckets.filter("id <> hub AND id <> first").select("key", "id").join(clusters, "id", "left").select(
        "key", "id", F.coalesce("cluster", "id").alias("cluster")))
    open_keys = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("cluster").alias("_a"), F.max("cluster").alias("_b")).filter(
        "_a <> _b").select("key", F.ceil(F.col("n") / BUCKET_ITEMS).cast("int").alias("blocks"))
    left = keep(rest.join(open_keys, "key"))
    few = max(1, left.count() // (8 * BUCKET_ITEMS))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    one = F.col("blocks") == 1
    dealt = left.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "id", "key", "cluster", F.when(one, F.lit(None)).otherwise(F.col("key")).alias("large"),
        F.when(one, F.pmod(F.xxhash64("key"), F.lit(few)).cast("int")).otherwise(F.least("own", "other")).alias("i"),
        F.greatest("own", "other").alias("j")).join(signs, "id")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable")
        key, ids, labels = (rows[c].to_numpy(np.int64) for c in ("key", "id", "cluster"))
        sig = np.stack(rows["sig"].to_list()).astype(np.int64).view(np.uint64)
        found = []
        root: dict[int, int] = {}

        def find(c):
            while root.setdefault(c, c) != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        for start, end in zip(edges[:-1], edges[1:]):
            own = labels[start:end]
            if (own == own[0]).all():
                continue
            for k, like in estimates(sig[start:end], bits):
                for at in np.flatnonzero((like >= least) & (own[k + 1 :] != own[k])):
                    x, y = start + k, start + k + 1 + at
                    a, b = find(int(labels[x])), find(int(labels[y]))
                    if a != b:
                        root[a] = b
                        x, y = (x, y) if ids[x] < ids[y] else (y, x)
                        found.append((ids[x], ids[y], like[at], labels[x], labels[y]))
        return pd.DataFrame(found, columns=["a", "b", "like", "a_cluster", "b_cluster"]).astype(
            {"a": "int64", "b": "int64", "like": "float64", "a_cluster": "int64", "b_cluster": "int64"})

    return keep(dealt.select("id", "key", "cluster", "sig", "large", "i", "j").groupBy("large", "i", "j").applyInPandas(
        compare, "a long, b long, like double, a_cluster long, b_cluster long"))


def by_bucket(left: DataFrame, buckets: DataFrame) -> DataFrame:
    """The rows (id, cluster, component, blocks), with large clusters cut into their buckets where that leaves fewer
    pairs: items that share no bucket are not candidates, and with the corpus chains of loosely similar items
    grow faster than buckets. Of a bucket whose items are of one component nothing is left."""
    large = left.filter(F.col("blocks") > WHOLE_BLOCKS)
    if large.isEmpty():
        return left
    met = keep(large.join(buckets.select("key", "id"), "id"))
    several = keep(met.groupBy("cluster", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("component").alias("_a"), F.max("component").alias("_b")).filter("_a <> _b").select("cluster", "key", "n"))
    pairs = several.groupBy("cluster").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("_p"))
    cut = keep(large.groupBy("cluster").agg(F.count(F.lit(1)).cast("double").alias("_n")).join(pairs, "cluster", "left").filter(
        F.coalesce("_p", F.lit(0.0)) < F.col("_n") * F.col("_n")).select("cluster"))
    parts = met.join(several, ["cluster", "key"]).join(cut, "cluster", "left_semi").select(
        "id", F.xxhash64("cluster", "key").alias("cluster"), "component", F.ceil(F.col("n") / BLOCK_ITEMS).cast("int").alias("blocks"))
    return left.join(cut, "cluster", "left_anti").select(*left.columns).union(parts)


def _parts(rows: list, size_of: Callable[[tuple], int]) -> Iterator[list]:
    """The rows in order, in parts of SET_BYTES or little more."""
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += size_of(row)
        if held >= SET_BYTES:
            yield part
            part, held = [], 0
    if part:
        yield part


def similar_components(items: DataFrame, words: int, bits: int, floor: float, texts_of: Callable[[Bits], DataFrame],
                       set_of: Callable[[bytes], np.ndarray], percent: int,
                       sets_of: Callable[[list[bytes]], list[np.ndarray]] | None = None) -> DataFrame:
    """id, component of the items linked with another.

    items: id (long), keys (array of band keys), sig (array of ``words`` packed words); rows of
    one id are one item. ``floor`` lies far below the threshold: signatures of unrelated items hardly
    ever reach it, so clusters hold items that have something in common.
    texts_of(filter) gives (id, text binary) of at least the ids that the filter hits, and
    set_of(text) the sorted distinct hashes of its set; sets_of(texts), where short texts are best
    taken together, the same of many.
    Linked: 100 * intersection >= percent * union, on the full sets."""
    buckets, held = shared_buckets(items, words)
    parts = [F.first(F.col("sig")[k]).alias(f"w{k}") for k in range(words)]
    signs = held.join(buckets.select("id").distinct(), "id", "left_semi").groupBy("id").agg(*parts)
    signs = keep(signs.select("id", F.array(*[f"w{k}" for k in range(words)]).alias("sig")))
    of = lambda name: signs.select(F.col("id").alias(name), F.col("sig").alias(f"{name}_sig"))

    asked = buckets.select("id", F.explode(F.array_distinct(F.array("hub", "first"))).alias("hub")).filter("id <> hub").select(
        F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    rated = keep(asked.join(of("a"), "a").join(of("b"), "b").withColumn(
        "like", estimated(F.col("a_sig"), F.col("b_sig"), words, bits)).filter(F.col("like") >= floor).select("a", "b", "like"))
    clusters = keep(components(rated).withColumnRenamed("component", "cluster"))
    least = max(floor, least_estimate(words * (64 // bits), bits, percent))
    more = bridges(buckets, clusters, signs, words, bits, least)
    if not more.isEmpty():
        rated = keep(rated.union(more.select("a", "b", "like").distinct()))
        joined = keep(components(more.select(F.col("a_cluster").alias("a"), F.col("b_cluster").alias("b"))).toDF("cluster", "_c"))
        alone = joined.select(F.col("cluster").alias("id")).join(clusters, "id", "left_anti").select("id", F.col("id").alias("cluster"))
        clusters = keep(clusters.select("id", "cluster").union(alone).join(joined, "cluster", "left").select(
            "id", F.coalesce("_c", "cluster").alias("cluster")))
    ends = rated.select(F.col("a").alias("id"), "a", "b", "like").union(rated.select(F.col("b").alias("id"), "a", "b", "like"))
    # An item rated lower with all its hubs is left to the blocks of its cluster, which compare all pairs.
    best = ends.filter(F.col("like") >= least).groupBy("id").agg(F.max(F.struct("like", "a", "b")).alias("x")).select("x.a", "x.b").distinct()

    texts = keep(texts_of(id_bits(ids_of(rated))).dropDuplicates(["id", "text"]))

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose full sets are similar enough."""

        def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = functools.lru_cache(maxsize=1000)(set_of)  # a hub has many pairs
            for batch in batches:
                good = []
                for part in _parts(list(zip(batch["a_text"], batch["b_text"])), lambda pair: len(pair[0]) + len(pair[1])):
                    if sets_of:
                        given = list({t for pair in part for t in pair})
                        own = dict(zip(given, sets_of(given))).__getitem__
                    for x, y in part:
                        x, y = own(x), own(y)
                        common = n_common(x, y) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                        good.append(100 * common >= percent * (len(x) + len(y) - common) > 0)
                yield batch.loc[np.array(good, bool), ["a", "b"]]

        named = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"{c}_text"))
        return pairs.join(named("a"), "a").join(named("b"), "b").select("a", "b", "a_text", "b_text").mapInPandas(check, "a long, b long").distinct()

    links = keep(verified(best))
    known = keep(components(links))

    # What is left: clusters of several components.
    member = clusters.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("_a"), F.max("component").alias("_b")).filter(
        "_a <> _b").select("cluster", F.ceil(F.col("n") / BLOCK_ITEMS).cast("int").alias("blocks"))
    left = keep(by_bucket(member.join(sizes, "cluster").select("id", "cluster", "component", "blocks"), buckets))
    n_left = left.count()
    if not n_left:
        return known
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    few = max(1, n_left // BLOCK_ITEMS)
    # Small clusters share tasks; a large one is cut into blocks, and each pair of blocks is a task.
    dealt = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("own", own).select(
        "id", "cluster", "component", F.when(F.col("blocks") == 1, F.lit(None)).otherwise(F.col("cluster")).alias("large"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(few)).cast("int")).otherwise(F.least("own", "other")).alias("i"),
        F.greatest("own", "other").alias("j")).join(texts, "id")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        rows = rows.sort_values("cluster", kind="stable")
        of, ids, labels, given = rows["cluster"].to_numpy(), rows["id"].tolist(), rows["component"].tolist(), rows["text"].tolist()
        edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]).tolist()
        apart = [(x, y) for x, y in zip(edges[:-1], edges[1:]) if len(set(labels[x:y])) > 1]
        for part in _parts(apart, lambda span: sum(map(len, given[span[0] : span[1]]))):
            texts = [t for x, y in part for t in given[x:y]]
            sets = iter(sets_of(texts) if sets_of else map(set_of, texts))
            for x, y in part:
                found += joining_links(ids[x:y], labels[x:y], [next(sets) for _ in range(x, y)], percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    more = keep(dealt.select("id", "cluster", "component", "text", "large", "i", "j").groupBy("large", "i", "j").applyInPandas(
        compare, "a long, b long").distinct())
    return known if more.isEmpty() else components(links.union(more))
