"""Column expressions used cell by cell: ranges, clipping, errors, hours."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foretrace.settings import Variable

SMAPE_EPS = 1e-8


def lookup(pairs: dict[str, float | None], key: Column | str = "variable") -> Column:
    """Value of a small literal table at ``key``; null when absent."""
    key = F.col(key) if isinstance(key, str) else key
    known = {k: v for k, v in pairs.items() if v is not None}
    if not known:
        return F.lit(None).cast("double")
    literal = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, float(v))])
    return F.try_element_at(literal, key)


def bounds(variables: Iterable[Variable], kind: str, key: Column | str = "variable") -> tuple[Column, Column]:
    """(low, high) of a range kind: plausible, valid, hard or sane; null = open."""
    pairs = {v.name: getattr(v, kind) for v in variables}
    return (
        lookup({k: p[0] for k, p in pairs.items()}, key),
        lookup({k: p[1] for k, p in pairs.items()}, key),
    )


def clip(value: Column, low: Column, high: Column) -> Column:
    """A null bound is open (greatest and least skip nulls) and a null value stays null."""
    return F.when(value.isNotNull(), F.greatest(low, F.least(high, value)))


def outside(value: Column, low: Column, high: Column) -> Column:
    """True only when the value is known to lie outside the range."""
    return F.coalesce((value < low) | (value > high), F.lit(False))


def known(value: Column | str) -> Column:
    """NaN is turned into null at the edges; operators only see null."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.isnan(value), F.lit(None)).otherwise(value)


def smape_cell(y_true: Column | str = "y_true", y_pred: Column | str = "y_pred") -> Column:
    y = F.col(y_true) if isinstance(y_true, str) else y_true
    p = F.col(y_pred) if isinstance(y_pred, str) else y_pred
    return 2 * F.abs(y - p) / (F.abs(y) + F.abs(p) + F.lit(SMAPE_EPS))


def hours_crossed(start: Column | str, end: Column | str) -> Column:
    """Hour boundaries crossed between two times (10:59 to 11:01 is one)."""
    a = F.date_trunc("HOUR", start)
    b = F.date_trunc("HOUR", end)
    return F.timestamp_diff("HOUR", a, b)


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed seconds; zoneless times are read in the session zone (use UTC)."""
    a, b = (F.unix_micros((F.col(t) if isinstance(t, str) else t).cast("timestamp")) for t in (start, end))
    return (b - a) / F.lit(1e6)


def half_width() -> Column:
    return (F.col("y_upper") - F.col("y_lower")) / 2


def observed() -> Column:
    """Cell with both a truth and a forecast."""
    return F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()
