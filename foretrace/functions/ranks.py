"""Exact ranks, quantiles and order statistics of arbitrarily large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretrace.functions.durable import durable

# Largest group (in distinct values) that one task may sort.
GROUP_LIMIT = 1_000_000


def running_totals(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column],
                   group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per (keys, distinct ``order`` value) with every sum, its running
    total ``<name>_cum`` (inclusive, ascending) and the key's ``<name>_total``.

    Equal values are combined before the shuffle, so a hot value costs one row
    per map task. The combined rows are materialised once; if some group still
    has more distinct values than one task should sort, the rows are range
    partitioned on (keys, value) and the running totals are stitched together
    from per-partition totals.
    """
    names = list(sums)
    pre = durable(df.groupBy(*keys, order).agg(*[F.sum(c).alias(n) for n, c in sums.items()]))
    sizes = pre.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c"), F.sum("c")).first()
    biggest, total = (sizes[0] or 0), (sizes[1] or 0)
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    if biggest <= group_limit:
        upto = group.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return pre.select(
            "*", *[F.sum(n).over(upto).alias(f"{n}_cum") for n in names],
            *[F.sum(n).over(group).alias(f"{n}_total") for n in names])

    parts = max(2, -(-4 * total // group_limit))
    # Materialised with its partition number: both readers below must agree on it.
    ranged = durable(pre.repartitionByRange(parts, *keys, order).withColumn("_part", F.spark_partition_id()))
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_part").agg(*[F.sum(n).alias(f"_t_{n}") for n in names])
        .select(*keys, "_part",
                *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names],
                *[F.sum(f"_t_{n}").over(group).alias(f"{n}_total") for n in names])
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(offsets, [*keys, "_part"])
        .select(*keys, order, *names,
                *[(F.col(f"_o_{n}") + F.sum(n).over(inside)).alias(f"{n}_cum") for n in names],
                *[F.col(f"{n}_total") for n in names])
    )


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column],
             group_limit: int = GROUP_LIMIT) -> DataFrame:
    """The values at given 1-based ranks per key; ``ranks`` are expressions of ``n_rows``."""
    cum = running_totals(df.filter(F.col(value).isNotNull()), keys, value, {"n": F.lit(1)}, group_limit)
    sized = cum.withColumnRenamed("n_total", "n_rows")
    holds = lambda r: (F.col("n_cum") - F.col("n") < r) & (r <= F.col("n_cum"))
    return sized.groupBy(*keys, "n_rows").agg(
        *[F.max(F.when(holds(r), F.col(value))).alias(name) for name, r in ranks.items()])


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
              group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Exact quantiles with linear interpolation, plus ``n_rows``."""
    spot = {name: F.lit(float(p)) * (F.col("n_rows") - 1) for name, p in probs.items()}
    ranks = {}
    for name, s in spot.items():
        ranks[f"_lo_{name}"] = F.floor(s) + 1
        ranks[f"_hi_{name}"] = F.ceil(s) + 1
    found = at_ranks(df, keys, value, ranks, group_limit)
    return found.select(
        *keys, "n_rows",
        *[(F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (s - F.floor(s))).alias(name)
          for name, s in spot.items()])


def positions(df: DataFrame, keys: list[str], order: str, position: str = "position",
              group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Dense 0-based position of each distinct ``order`` value within its key."""
    cum = running_totals(df.select(*keys, order).distinct(), keys, order, {"n": F.lit(1)}, group_limit)
    return cum.select(*keys, order, (F.col("n_cum") - 1).alias(position))
