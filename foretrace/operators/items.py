"""Resolve dictionary labels to panel variables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.settings import Variable


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def label_matches(variable: Variable, label: str = "label") -> Column:
    """Label contains (or, for exact, equals) a pattern, ignoring case; '%' and '_'
    stay wildcards. Excludes are plain substrings; a null label counts as empty."""
    column = F.col(label)
    escaped = [p.replace("\\", "\\\\") for p in variable.label_patterns]
    wanted = [column.ilike(p if variable.match == "exact" else f"%{p}%") for p in escaped]
    lowered = F.lower(F.coalesce(column, F.lit("")))
    banned = [lowered.contains(x.lower()) for x in variable.exclude_patterns]
    return F.coalesce(_any(wanted), F.lit(False)) & ~_any(banned)


def _item_matches(variable: Variable, has_fluid: bool) -> Column:
    matched = label_matches(variable)
    if variable.fluids:
        if not has_fluid:
            raise ValueError(f"{variable.name}: the dictionary has no fluid column")
        fluid = F.lower(F.coalesce(F.col("fluid"), F.lit("")))
        matched = matched & fluid.isin([f.lower() for f in variable.fluids])
    return matched


def resolve(items: DataFrame, variables: list[Variable], source: str) -> DataFrame:
    """(variable, source, itemid, label): one narrow pass over the dictionary.

    The patterns are configuration, so each variable is one literal predicate
    and no join is needed; an item may serve several variables.
    """
    chosen = [v for v in variables if v.source == source]
    hits = F.array_compact(F.array(*[
        F.when(_item_matches(v, "fluid" in items.columns), F.lit(v.name)) for v in chosen]))
    return items.select(F.explode(hits).alias("variable"), F.lit(source).alias("source"), "itemid", "label")


def with_unmatched(mapping: DataFrame, variables: list[Variable]) -> DataFrame:
    """Number of items per variable; a variable without any is kept with zero."""
    spark = mapping.sparkSession
    panel = spark.createDataFrame([(v.name, v.source) for v in variables], "variable string, source string")
    return (
        F.broadcast(panel)  # one row per configured variable
        .join(mapping.groupBy("variable").agg(F.count("itemid").alias("n_items")), "variable", "left")
        .select("variable", "source", F.coalesce("n_items", F.lit(0)).alias("n_items"))
    )


def pushable_ids(mapping: DataFrame, limit: int = 1000) -> list[int] | None:
    """The item ids as a list when there are at most ``limit`` of them, else None.
    A list can be pushed into the event scan; a larger set stays a semi-join."""
    rows = mapping.select("itemid").distinct().limit(limit + 1).collect()
    return sorted(r[0] for r in rows) if len(rows) <= limit else None


def item_ids(items: DataFrame, labels: list[str]) -> DataFrame:
    """Distinct item ids whose label contains any of ``labels``."""
    drug = Variable(name="drug", label_patterns=tuple(labels))
    return items.filter(label_matches(drug)).select("itemid").distinct()
