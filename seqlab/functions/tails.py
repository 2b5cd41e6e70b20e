"""Tails of distributions: as column expressions where a closed form exists, else for the few rows of a test table."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_two_sided(z: Column) -> Column:
    """Two-sided tail of the standard normal, by the rational form 7.1.26 of Abramowitz and Stegun (error below 2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    u = 1 / (1 + 0.3275911 * x)
    return u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429)))) * F.exp(-x * x)


#: Coefficients of Acklam's rational approximation of the inverse normal, for the middle and for the ends.
NORMAL_MIDDLE = ((-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239), (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0))
NORMAL_ENDS = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996, 3.754408661907416, 1.0))


def normal_quantile(p: Column) -> Column:
    """The standard normal's quantile of p, strictly between 0 and 1 (relative error below 1.2e-9)."""

    def along(coefficients, x):
        return reduce(lambda a, c: a * x + c, coefficients[1:], F.lit(coefficients[0]))

    def end(tail):
        x = F.sqrt(-2 * F.ln(tail))
        return along(NORMAL_ENDS[0], x) / along(NORMAL_ENDS[1], x)

    q = p - 0.5
    middle = q * along(NORMAL_MIDDLE[0], q * q) / along(NORMAL_MIDDLE[1], q * q)
    return F.when(p < 0.02425, end(p)).when(p > 1 - 0.02425, -end(1 - p)).otherwise(middle)


def chi_square(x: Column, df: int) -> Column:
    """Upper tail of chi-square with df degrees: a finite sum, and for odd df a normal tail as well."""
    half = x / 2
    if df % 2 == 0:
        terms = [F.pow(half, F.lit(k)) / math.factorial(k) for k in range(df // 2)]
        return F.exp(-half) * sum(terms[1:], terms[0])
    terms = [F.pow(half, F.lit(k - 0.5)) / math.gamma(k + 0.5) for k in range(1, (df - 1) // 2 + 1)]
    return normal_two_sided(F.sqrt(x)) + F.exp(-half) * sum(terms, F.lit(0.0))


def kolmogorov(d: Column, n: Column, terms: int = 40) -> Column:
    """Tail of the Kolmogorov distribution for distance d and effective size n, by its series with Stephens' correction.

    The series is summed only where it converges fast; below, the tail is 1.
    """
    root = F.sqrt(n)
    x = (root + 0.12 + 0.11 / root) * d
    series = sum((F.exp(-2.0 * k * k * x * x) * (2.0 if k % 2 else -2.0) for k in range(2, terms + 1)), 2.0 * F.exp(-2.0 * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.least(series, F.lit(1.0)), F.lit(0.0)))


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 8 (error below 1e-10)."""
    x = n + 8.0
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    return series - sum((F.log(n + k) for k in range(2, 9)), F.log(n + 1))


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def hypergeometric(k: Column, drawn: Column, marked: Column, size: Column) -> Column:
    """Chance of k marked among drawn out of size."""
    return F.exp(log_choose(marked, k) + log_choose(size - marked, drawn - k) - log_choose(size, drawn))


def _upper_share(both: int, drawn: int, marked: int, size: int, block: int = 8192) -> float:
    """Chance of both or more marked among drawn out of size."""
    low, high = max(0, drawn + marked - size), min(drawn, marked)
    mode = min(max((drawn + 1) * (marked + 1) // (size + 2), low), high)
    rest = float(size - drawn - marked)
    above, below = (1.0, 0.0) if mode >= both else (0.0, 1.0)

    def blocks(end: int, side: int):
        """Terms from beside the mode to end, the mode's being 1, and the last's ratio."""
        last, k = 1.0, mode
        while k != end and last > 0:
            at = k + side * np.arange(min(block, abs(end - k)), dtype=np.float64)
            ratio = (drawn - at) * (marked - at) / ((at + 1) * (rest + at + 1)) if side > 0 else at * (rest + at) / ((drawn - at + 1) * (marked - at + 1))
            terms = last * np.cumprod(ratio)
            yield k + side * np.arange(1, len(at) + 1), terms, ratio[-1]
            last, k = float(terms[-1]), k + side * len(at)

    for end, side in ((high, 1), (low, -1)):
        for at, terms, ratio in blocks(end, side):
            above, below = above + float(terms[at >= both].sum()), below + float(terms[at < both].sum())
            smallest = above if side > 0 else min(above, below) or 1.0
            if (at[-1] >= both or side < 0) and ratio < 1 and terms[-1] * ratio / (1 - ratio) < 1e-17 * smallest:
                break
    return above / (above + below)


@F.pandas_udf(DoubleType())
def fisher_greater(both: pd.Series, only_a: pd.Series, only_b: pd.Series, neither: pd.Series) -> pd.Series:
    """One-sided Fisher p: the chance of both or more, margins held; for the rows of a table of tests.

    Terms follow from the most likely one by their ratios, both ways, until all that are left together are under 1e-17 of
    the sum they would go to. So their number grows with the spread, not the size, and they don't overflow.
    """

    def one(n, a, b, c):
        return None if pd.isna(n) or pd.isna(a) or pd.isna(b) or pd.isna(c) else _upper_share(int(n), int(n + a), int(n + b), int(n + a + b + c))

    return pd.Series([one(*row) for row in zip(both, only_a, only_b, neither)], dtype="float64")


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, out = 1.0, 1 / (1 - (a + b) * x / (a + 1)), 0.0
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d)
            c = 1 + top / c
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * out


@F.pandas_udf(DoubleType())
def f_tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Upper tail of F, null for a null or an empty degree; for the few rows of a table of tests."""
    def one(x, m, n):
        return None if pd.isna(x) or m <= 0 or n <= 0 else _beta_tail(n / 2, m / 2, n / (n + m * x))

    return pd.Series([one(*row) for row in zip(f, df1, df2)], dtype="float64")


@F.pandas_udf(DoubleType())
def binomial_two_sided(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """Exact two-sided binomial p: twice the smaller tail, at most 1; for the few rows of a table of tests."""

    def one(k, n, p):
        upper = 1.0 if k <= 0 else _beta_tail(k, n - k + 1, p)
        lower = 1.0 if k >= n else 1 - _beta_tail(k + 1, n - k, p)
        return min(1.0, 2 * min(upper, lower))

    return pd.Series([one(*row) for row in zip(k, n, p)], dtype="float64")


def t_two_sided(t: Column, df: Column) -> Column:
    return f_tail(t * t, F.lit(1.0), df.cast("double"))
