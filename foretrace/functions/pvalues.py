"""p-values of the test statistics, one row per finished comparison.

The law is an argument. "normal" (for the rank tests) and "limit" (for Kolmogorov-Smirnov)
are built-in column expressions, the same at every sample size. "exact" is the law of small
samples without ties; it counts orders, so its cost grows with the sample sizes, and rows with ties
take the normal law.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship this module's helpers with the tasks, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Points of the midpoint rule, which is exact to double precision for |z| >= 0.1.
POINTS = 400
TERMS = 12


def _column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _total(n: int, term) -> Column:
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), term), F.lit(0.0), lambda a, x: a + x)


def normal_two_sided(z) -> Column:
    """P(|Z| >= |z|), null for a null z: the mean of exp(-z^2 / (2 sin^2 t)) over a quarter turn,
    and its series near 0."""
    z = F.abs(_column(z))
    far = _total(POINTS, lambda i: F.exp(-z * z / (2 * F.pow(F.sin((i + 0.5) * (math.pi / (2 * POINTS))), 2)))) / POINTS
    near = 1 - math.sqrt(2 / math.pi) * (z - F.pow(z, 3) / 6 + F.pow(z, 5) / 40 - F.pow(z, 7) / 336)
    return F.when(z < 0.1, near).otherwise(far)


def kolmogorov_p(d, n1, n2) -> Column:
    """Two-sided p of the two-sample distance by the limit law, in whichever of its two series
    converges at once."""
    n1, n2 = _column(n1).cast("double"), _column(n2).cast("double")
    x = _column(d) * F.sqrt(F.try_divide(n1 * n2, n1 + n2))
    large = 2 * _total(TERMS, lambda i: F.when(i % 2 == 0, 1.0).otherwise(-1.0) * F.exp(-2 * F.pow((i + 1) * x, 2)))
    small = 1 - math.sqrt(2 * math.pi) / x * _total(TERMS, lambda i: F.exp(-F.pow((2 * i + 1) * math.pi / x, 2) / 8))
    p = F.when(x <= 0, 1.0).when(x < 1, small).otherwise(large)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def exact_signed_rank(n: int, w_plus: float) -> float:
    """Two-sided p of the signed-rank statistic without ties, n small."""
    counts = [1] + [0] * (n * (n + 1) // 2)
    for r in range(1, n + 1):
        for s in range(len(counts) - 1, r - 1, -1):
            counts[s] += counts[s - r]
    w = int(min(w_plus, n * (n + 1) / 2 - w_plus))
    return min(1.0, 2.0 * sum(counts[: w + 1]) / 2.0**n)


def exact_rank_sum(n1: int, n2: int, u: float) -> float:
    """Two-sided p of the rank-sum statistic without ties, small samples."""
    n1, n2 = min(n1, n2), max(n1, n2)
    top = n1 * n2
    table = [[0] * (top + 1) for _ in range(n1 + 1)]
    table[0][0] = 1
    for j in range(1, n2 + n1 + 1):
        for i in range(min(j, n1), 0, -1):
            shift = j - i
            for s in range(top, shift - 1, -1):
                table[i][s] += table[i - 1][s - shift]
    low = int(math.floor(min(u, top - u)))
    ways = math.comb(n1 + n2, n1)
    return min(1.0, 2.0 * sum(table[n1][: low + 1]) / ways)


def exact_kolmogorov(d: float, n1: int, n2: int) -> float:
    """Two-sided two-sample p without ties: the share of orders whose distance stays below d,
    counted along lattice paths one row at a time."""
    if d <= 0:
        return 1.0
    gap = round(d * n1 * n2)
    j = np.arange(n2 + 1)
    paths = np.where(np.abs(j * n1) < gap, 1.0, 0.0)
    paths = np.where(np.cumprod(paths) > 0, 1.0, 0.0)
    for i in range(1, n1 + 1):
        inside = np.abs(i * n2 - j * n1) < gap
        # Each step divides by the number of orders so far, to stay within doubles.
        row, left = np.zeros(n2 + 1), 0.0
        for k in range(n2 + 1):
            left = (paths[k] * i / (i + k) + left * k / (i + k)) if inside[k] else 0.0
            row[k] = left
        paths = row
    return float(min(1.0, max(0.0, 1.0 - paths[n2])))


def _exact(law):
    @F.pandas_udf(T.DoubleType())
    def p(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(y) or pd.isna(z) else law(x, y, z) for x, y, z in zip(a, b, c)], dtype="float64")

    return p


def _check(law: str, known: tuple[str, str]) -> None:
    if law not in known:
        raise ValueError(f"unknown law {law!r}; one of {known}")


def wilcoxon_p(n, w_plus, has_ties, z, law: str = "normal") -> Column:
    """Signed-rank test; ``n`` counts the non-zero differences."""
    _check(law, ("normal", "exact"))
    normal = F.when(_column(n) > 0, normal_two_sided(z))
    if law == "normal":
        return normal
    exact = _exact(lambda count, w, _: exact_signed_rank(int(count), float(w)) if count else None)
    return F.when(_column(has_ties), normal).otherwise(exact(_column(n).cast("double"), _column(w_plus).cast("double"), F.lit(0.0)))


def rank_sum_p(n1, n2, u, has_ties, z, law: str = "normal") -> Column:
    """Rank-sum test, with the continuity correction that ``z`` carries."""
    _check(law, ("normal", "exact"))
    z = _column(z)
    normal = F.when((_column(n1) > 0) & (_column(n2) > 0), F.when(z < 0, 1.0).otherwise(normal_two_sided(z)))
    if law == "normal":
        return normal
    exact = _exact(lambda a, b, s: exact_rank_sum(int(a), int(b), float(s)) if a and b else None)
    return F.when(_column(has_ties), normal).otherwise(exact(_column(n1).cast("double"), _column(n2).cast("double"), _column(u).cast("double")))


def ks_p(d, n1, n2, law: str = "limit") -> Column:
    _check(law, ("limit", "exact"))
    if law == "limit":
        return kolmogorov_p(d, n1, n2)
    exact = _exact(lambda x, a, b: exact_kolmogorov(float(x), int(a), int(b)) if a and b else None)
    return exact(_column(d), _column(n1).cast("double"), _column(n2).cast("double"))
