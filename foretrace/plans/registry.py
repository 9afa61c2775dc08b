"""Registered queries: a Spark callable, a typed column list and optional SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CASTS = {"i": "long", "s": "string", "b": "boolean"}
_SQL_CASTS = {"i": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN"}
DECIMALS = 5
# Added before rounding on both sides, so that a value exactly halfway (a short
# decimal divided by a power of two) rounds the same way in both engines.
NUDGE = 7e-10


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
# Shared common table expressions of the SQL side, in definition order.
PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql.strip()


def register(name: str, columns: str, sql: str | None = None):
    """``columns`` like 'stay_id:i value:d'; i long, d double rounded to five places,
    s string, b boolean. Both sides are projected to exactly these."""
    spec = tuple(tuple(c.split(":")) for c in columns.split())

    def wrap(fn):
        QUERIES[name] = Query(name, spec, fn, sql)
        return fn

    return wrap


def tidy(df: DataFrame, spec) -> DataFrame:
    return df.select(*[
        F.round(F.col(n).cast("double") + NUDGE, DECIMALS).alias(n) if t == "d" else F.col(n).cast(_CASTS[t]).alias(n)
        for n, t in spec])


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(q: Query):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return tidy(q.build(spark, sf), q.columns)

        return run

    return {name: runner(q) for name, q in QUERIES.items()}


def _needed(sql: str) -> list[str]:
    """The parts a statement uses, directly or not, in definition order."""
    words = set(re.findall(r"[a-z_][a-z0-9_]*", sql))
    names = list(PARTS)
    found: set[str] = set()
    frontier = {n for n in names if n in words}
    while frontier:
        found |= frontier
        more = set()
        for n in frontier:
            used = set(re.findall(r"[a-z_][a-z0-9_]*", PARTS[n]))
            more |= {m for m in names if m in used and m != n}
        frontier = more - found
    return [n for n in names if n in found]


def oracle(q: Query) -> str:
    head = ",\n".join(f"{n} AS (\n{PARTS[n]}\n)" for n in _needed(q.sql))
    outer = ", ".join(
        f'round(CAST("{n}" AS DOUBLE) + {NUDGE!r}, {DECIMALS}) AS "{n}"' if t == "d" else f'CAST("{n}" AS {_SQL_CASTS[t]}) AS "{n}"'
        for n, t in q.columns)
    final = f"final_result AS (\n{q.sql.strip()}\n)"
    return f"WITH {head + ',' if head else ''}\n{final}\nSELECT {outer} FROM final_result"


def oracle_queries() -> dict[str, str]:
    return {name: oracle(q) for name, q in QUERIES.items() if q.sql}
