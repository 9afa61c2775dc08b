"""Bootstrap resamples of a multinomial law in one pass over the rows.

A resample of n rows makes n draws. The rows of a key are cut by their hash into the leaves of a binary
tree, and each resample's draws are split down the tree binomially, in proportion to the rows on
both sides. What falls on a leaf is then drawn there, in the task that holds the leaf's rows, so that
only one sum per resample leaves it. Equal to n draws from all rows in law, whatever the depth.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretrace.functions.draws import digest, long_word
from foretrace.functions.durable import durable

# Ship this module's helpers with the tasks, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAF_ROWS = 2048  # rows that one leaf should have, until a key has 2**DEEPEST leaves
DEEPEST = 12
DRAWS_AT_ONCE = 1 << 20
BUCKETS = 1024  # of an order statistic's first look
# The multipliers of the mixer, below 2**31 so that products of 32-bit words fit a
# signed 64-bit integer in SQL as well.
MULTIPLIERS = (0x7FEB352D, 0x2C1B3C6D)
STREAMS = (0x3C6EF372, 0x1F83D9AB, 0x5BE0CD19, 0x510E527F)
_MASK = 0xFFFFFFFF


def mixed_word(x: int) -> int:
    """One to one on 32-bit words."""
    x = ((x ^ (x >> 16)) * MULTIPLIERS[0]) & _MASK
    x = ((x ^ (x >> 15)) * MULTIPLIERS[1]) & _MASK
    return x ^ (x >> 16)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(MULTIPLIERS[0])
    x = (x ^ (x >> np.uint32(15))) * np.uint32(MULTIPLIERS[1])
    return x ^ (x >> np.uint32(16))


def stream_starts(seed: int, leaf: int = 0) -> list[int]:
    """Where the words of a leaf's draws begin: two words for the resample, two for the draw."""
    return [mixed_word(mixed_word((seed ^ s) & _MASK) ^ mixed_word(leaf & _MASK)) for s in STREAMS]


def drawn_positions(starts: list[int], resamples: np.ndarray, draws: np.ndarray, rows: int) -> np.ndarray:
    """Position of each draw (any shape that both numbers broadcast to), from 62 hash bits."""
    b, j = resamples.astype(np.uint32), draws.astype(np.uint32)
    high = _mixed(_mixed(b ^ np.uint32(starts[0])) ^ _mixed(j ^ np.uint32(starts[2])))
    low = _mixed(_mixed(b ^ np.uint32(starts[1])) ^ _mixed(j ^ np.uint32(starts[3])))
    return ((high.astype(np.uint64) << np.uint64(30)) | (low >> np.uint32(2)).astype(np.uint64)) % np.uint64(rows)


def mix_sql(x: str) -> str:
    """The mixer over a BIGINT expression in [0, 2**32), in portable SQL."""
    once = f"((xor({x}, ({x}) >> 16) * {MULTIPLIERS[0]}) & {_MASK})"
    return f"list_transform([list_transform([{once}], lambda y: (xor(y, y >> 15) * {MULTIPLIERS[1]}) & {_MASK})[1]], lambda z: xor(z, z >> 16))[1]"


def counts_by_leaf(path: list[tuple[int, int, bool]], rows: int, resamples: int, seed: int, leaf: int) -> np.ndarray:
    """How many of its draws each resample makes on a leaf. ``path``: from the root down, the rows
    below the node, those below its left child, and whether the leaf is on the right."""
    counts = np.full(resamples, path[0][0] if path else rows, np.int64)
    for level, (whole, left, right) in enumerate(path):
        node = leaf >> (len(path) - level)  # leaves below one node make the same split
        rng = np.random.Generator(np.random.Philox(key=[seed & _MASK, (level << 32) | node]))
        to_left = rng.binomial(counts, left / whole)
        counts = counts - to_left if right else to_left
    return counts


def weights_of_leaf(path, rows: int, resamples: int, seed: int, leaf: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(resamples, weights): how often each of the leaf's rows is drawn, some resamples at a time."""
    counts = counts_by_leaf(path, rows, resamples, seed, leaf)
    starts = stream_starts(seed, leaf)
    step = max(1, DRAWS_AT_ONCE // max(1, int(counts.max())))
    for begun in range(0, resamples, step):
        some = np.arange(begun, min(resamples, begun + step))
        weights = np.zeros((len(some), rows), np.int64)
        most = int(counts[some].max())
        for at in range(0, most, DRAWS_AT_ONCE):
            draws = np.arange(at, min(most, at + DRAWS_AT_ONCE))
            positions = drawn_positions(starts, some[:, None], draws[None, :], rows).astype(np.int64)
            made = draws[None, :] < counts[some][:, None]
            flat = (positions + np.arange(len(some))[:, None] * rows)[made]
            weights += np.bincount(flat, minlength=weights.size).reshape(weights.shape)
        yield some, weights


def leaves(df: DataFrame, keys: list[str], id_col: str, columns: list[str], seed: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(keys, leaf, path, rows): one row per leaf, ``rows`` an array of the columns in the order of the
    seeded hash of ``id_col``. The rows are written once: counts and leaves must agree on them."""
    hashed = durable(df.select(*keys, digest(seed, F.col(id_col)).alias("_h"), F.col(id_col).cast("string").alias("_id"), *columns))
    n = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    depth = F.least(F.lit(DEEPEST), F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / leaf_rows)))).cast("int")
    depths = n.select(*keys, depth.alias("_depth"))
    cut = F.when(F.col("_depth") == 0, 0).otherwise(F.expr("shiftright(_w, 60 - _depth)")).cast("long")
    placed = hashed.join(depths, keys).withColumn("_w", long_word(F.col("_h"), 0)).withColumn("leaf", cut)
    whole = placed.groupBy(*keys, "leaf", "_depth").agg(
        F.array_sort(F.collect_list(F.struct("_h", "_id", *columns))).alias("rows"))
    whole = durable(whole.withColumn("_size", F.size("rows")))
    # At most 2**DEEPEST leaves of a key; sizes only.
    sizes = whole.groupBy(*keys).agg(F.collect_list(F.struct("leaf", "_size")).alias("_sizes"))

    def ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                found = {int(s["leaf"]): int(s["_size"]) for s in row["_sizes"]}
                depth = int(row["_depth"])
                upto = np.r_[0, np.cumsum([found.get(k, 0) for k in range(1 << depth)])]
                for leaf in found:
                    path = []
                    for level in range(depth):
                        width = 1 << (depth - level)
                        first = leaf // width * width
                        middle = first + width // 2
                        path.append({"whole": int(upto[first + width] - upto[first]), "left": int(upto[middle] - upto[first]),
                                     "right": leaf >= middle})
                    out.append({**{k: row[k] for k in keys}, "leaf": leaf, "path": path})
            yield pd.DataFrame(out, columns=[*keys, "leaf", "path"])

    kinds = _kinds(df, keys)
    paths = sizes.join(depths, keys).mapInPandas(ways, f"{kinds}, leaf long, path array<struct<whole: long, left: long, right: boolean>>")
    return whole.select(*keys, "leaf", "rows").join(paths, [*keys, "leaf"])


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _spread(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.repartition(found.sparkSession.sparkContext.defaultParallelism, *keys, "leaf")


def _path(found) -> list[tuple[int, int, bool]]:
    return [(int(p["whole"]), int(p["left"]), bool(p["right"])) for p in found]


def resampled_sums(df: DataFrame, keys: list[str], id_col: str, columns: list[str], resamples: int, seed: int,
                   leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(keys, b, one sum per column): for each resample, sums over as many draws with replacement as
    the key has rows, and ``draws``, their number. A task sends a leaf's sums only."""
    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                values = np.array([[float(r[c]) for c in columns] for r in row["rows"]])
                for some, weights in weights_of_leaf(_path(row["path"]), len(values), resamples, seed, int(row["leaf"])):
                    sums = weights @ values
                    yield pd.DataFrame({**{k: [row[k]] * len(some) for k in keys}, "b": some, "draws": weights.sum(axis=1),
                                        **{c: sums[:, i] for i, c in enumerate(columns)}})

    spread = _spread(leaves(df, keys, id_col, columns, seed, leaf_rows), keys)
    sums = spread.mapInPandas(summed, f"{_kinds(df, keys)}, b long, draws long, " + ", ".join(f"`{c}` double" for c in columns))
    return sums.groupBy(*keys, "b").agg(F.sum("draws").alias("draws"), *[F.sum(c).alias(c) for c in columns])


def resampled_at_rank(df: DataFrame, keys: list[str], id_col: str, values: str, resamples: int, seed: int, rank: Column,
                      leaf_rows: int = LEAF_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """(keys, b, value): for each resample of the rows, the value at ``rank`` (an expression of ``n_rows``,
    1-based) among all values of the rows drawn. ``values``: an array column, known values only.

    A weighted order statistic in two looks. Tasks first add up, per resample, the weights that fall
    between cut points of the key's values; that shows which bucket holds the rank. Only this
    bucket's values are then sent, with their weights."""
    placed = durable(leaves(df, keys, id_col, [values], seed, leaf_rows))
    flat = df.select(*keys, F.explode(values).alias("_v"))
    shares = F.array(*[F.lit((k + 1) / buckets) for k in range(buckets - 1)])
    cuts = durable(flat.groupBy(*keys).agg(F.percentile_approx("_v", shares, 10 * buckets).alias("_cuts")))

    def leaf_values(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of a leaf, the row that each belongs to, and its bucket."""
        lists = [np.asarray(r[values], float) for r in row["rows"]]
        found = np.concatenate(lists)
        return found, np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.searchsorted(np.unique(row["_cuts"]), found)

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_dict("records"):
                _, owner, bucket = leaf_values(row)
                total = sums.setdefault(tuple(row[k] for k in keys), np.zeros((resamples, buckets), np.int64))
                for some, weights in weights_of_leaf(_path(row["path"]), len(row["rows"]), resamples, seed, int(row["leaf"])):
                    for i, b in enumerate(some):
                        total[b] += np.bincount(bucket, weights[i][owner], buckets).astype(np.int64)
        for key, total in sums.items():
            some = np.flatnonzero(total.any(axis=0))
            yield pd.DataFrame({**{k: [v] * len(some) for k, v in zip(keys, key)}, "bucket": some, "weights": list(total.T[some])})

    def added(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{k: parts[k].iloc[:1] for k in (*keys, "bucket")}, "weights": [np.sum(list(parts["weights"]), axis=0)]})

    with_cuts = _spread(placed, keys).join(F.broadcast(cuts) if _few(cuts) else cuts, keys)
    kind = f"{_kinds(df, keys)}, bucket long, weights array<long>"
    first = with_cuts.mapInPandas(weighed, kind).groupBy(*keys, "bucket").applyInPandas(added, kind)
    sent = first.select(*keys, "bucket", F.posexplode("weights").alias("b", "w"))
    upto = Window.partitionBy(*keys, "b").orderBy("bucket")
    summed = sent.withColumn("_upto", F.sum("w").over(upto)).withColumn("n_rows", F.sum("w").over(Window.partitionBy(*keys, "b")))
    holds = (F.col("_upto") - F.col("w") < rank) & (F.col("_upto") >= rank)
    opened = durable(summed.filter(holds).select(*keys, F.col("b").cast("long").alias("b"), "bucket", (rank - F.col("_upto") + F.col("w")).alias("rest")))
    wanted = opened.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("b", "bucket"))).alias("_open"))

    def sent_values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                found, owner, bucket = leaf_values(row)
                asked = {int(o["b"]): int(o["bucket"]) for o in row["_open"]}
                inside = {k: np.flatnonzero(bucket == k) for k in set(asked.values())}
                for some, weights in weights_of_leaf(_path(row["path"]), len(row["rows"]), resamples, seed, int(row["leaf"])):
                    out = []
                    for i, b in enumerate(some):
                        at = inside.get(asked.get(int(b)), np.zeros(0, int))
                        w = weights[i][owner[at]]
                        out.append(pd.DataFrame({"b": np.full(len(at), b), "value": found[at], "w": w})[w > 0])
                    joined = pd.concat(out)
                    for k in keys:
                        joined[k] = row[k]
                    yield joined[[*keys, "b", "value", "w"]]

    second = with_cuts.join(wanted, keys).mapInPandas(sent_values, f"{_kinds(df, keys)}, b long, value double, w long")
    values_of = second.groupBy(*keys, "b", "value").agg(F.sum("w").alias("w")).join(opened.drop("bucket"), [*keys, "b"])
    reached = values_of.withColumn("_upto", F.sum("w").over(Window.partitionBy(*keys, "b").orderBy("value"))).filter("_upto >= rest")
    return reached.groupBy(*keys, "b").agg(F.min("value").alias("value"))


def _few(table: DataFrame, rows: int = 1000) -> bool:
    """Whether a written table has at most so many rows (of bounded width)."""
    return table.limit(rows + 1).count() <= rows
