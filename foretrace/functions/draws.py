"""Hash-based randomness: the same draw whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DIGITS = 3


def _column(part) -> Column:
    return part if isinstance(part, Column) else F.lit(part)


def digest(*parts) -> Column:
    """md5 of the parts joined with ':'."""
    return F.md5(F.concat_ws(":", *[_column(p).cast("string") for p in parts]))


def word(hexdigest: Column, index: int = 0) -> Column:
    """The index-th group of eight hex digits as a non-negative integer."""
    return F.conv(F.substring(hexdigest, 1 + 8 * index, 8), 16, 10).cast("long")


LONG_RANGE = float(1 << 60)


def long_word(hexdigest: Column, index: int = 0) -> Column:
    """The index-th half of the digest, cut to fifteen hex digits: 60 bits, non-negative."""
    return F.conv(F.substring(hexdigest, 1 + 16 * index, 15), 16, 10).cast("long")


def draw(*parts) -> Column:
    return word(digest(*parts))


def unit(*parts) -> Column:
    """Uniform in [0, 1)."""
    return draw(*parts) / F.lit(4294967296.0)


def hashed_position(df: DataFrame, seed, id_col: str, keys: tuple[str, ...] = (),
                    position: str = "position", total: str = "n_rows") -> DataFrame:
    """Dense 0-based position of every row in the seeded hash order of its id.

    The order key is uniform, so its leading hex digits cut each group into
    4096 even buckets: counts per bucket give the offsets, and only rows of one
    bucket are ever sorted together, however large or skewed the groups are.
    """
    keys = list(keys)
    hashed = df.withColumn("_h", digest(seed, F.col(id_col))).withColumn(
        "_b", F.substring("_h", 1, BUCKET_DIGITS))
    per_key = Window.partitionBy(*(keys or [F.lit(0)]))
    before = per_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        .withColumn(total, F.sum("_c").over(per_key))
        .drop("_c")
    )
    in_bucket = Window.partitionBy(*keys, "_b").orderBy("_h", id_col)
    return (
        hashed.join(offsets, [*keys, "_b"])
        .withColumn(position, F.col("_off") + F.row_number().over(in_bucket) - 1)
        .drop("_h", "_b", "_off")
    )
