"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96
#: A rational Chebyshev fit of the complementary error function (fractional error below 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.when(b != 0, a.cast("double") / b)


def correlation(a: Column, b: Column) -> Column:
    """Correlation as an aggregate, null where either side does not vary or fewer than two pairs are complete."""
    x, y = F.when(b.isNotNull(), a).cast("double"), F.when(a.isNotNull(), b).cast("double")
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0."""
    t = 1 / (1 + x / 2)
    poly = F.lit(0.0)
    for c in reversed(ERFC):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Score interval of a proportion; null for n <= 0."""
    n = F.when(n > 0, n.cast("double"))
    p = k / n
    d = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), F.when(n > 0, F.least(F.lit(1.0), centre + half))


def newcombe(k1: Column, n1: Column, k2: Column, n2: Column, z: float = Z) -> tuple[Column, Column]:
    """Interval of a difference of proportions from two score intervals."""
    (l1, u1), (l2, u2) = wilson(k1, n1, z), wilson(k2, n2, z)
    p1, p2 = ratio(k1, n1), ratio(k2, n2)
    lo = (p1 - p2) - F.sqrt(F.pow(p1 - l1, 2) + F.pow(u2 - p2, 2))
    hi = (p1 - p2) + F.sqrt(F.pow(u1 - p1, 2) + F.pow(p2 - l2, 2))
    some = (n1 > 0) & (n2 > 0)
    return F.when(some, F.greatest(F.lit(-1.0), lo)), F.when(some, F.least(F.lit(1.0), hi))


def two_proportion_p(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Two-sided p-value of equal proportions by the pooled z test; 1 where nothing varies."""
    p = (k1 + k2) / (n1 + n2)
    se = F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    z = F.abs(k1 / n1 - k2 / n2) / F.when(se > 0, se)
    return F.when((n1 > 0) & (n2 > 0), F.when(se == 0, F.lit(1.0)).otherwise(erfc(z / F.lit(2.0**0.5))))


def benjamini_hochberg(df: DataFrame, p: str = "p_value", family: list[str] | None = None, key: list[str] | None = None, out: str = "q_value") -> DataFrame:
    """df plus q-values within each family of tests; null p-values count for nothing. key: columns that break ties of rank."""
    family, key = family or [], key or []
    ranked = Window.partitionBy(*family).orderBy(F.col(p).asc_nulls_last(), *key)
    above = Window.partitionBy(*family).orderBy(F.col(p).desc_nulls_first(), *(F.desc(k) for k in key)).rowsBetween(Window.unboundedPreceding, 0)
    scaled = F.col(p) * F.count(p).over(Window.partitionBy(*family)) / F.row_number().over(ranked)
    return df.withColumn("_scaled", scaled).withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_scaled").over(above)))).drop("_scaled")


def fisher_interval(r: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Interval of a correlation; null for n <= 3."""
    bounded = F.greatest(F.least(r, F.lit(1 - 1e-12)), F.lit(-1 + 1e-12))
    w = F.atanh(bounded)
    s = z / F.sqrt(F.when(n > 3, n - 3).cast("double"))
    return F.tanh(w - s), F.tanh(w + s)


def average_rank(value: Column, within: list[str]) -> Column:
    """Rank from the least value, ties sharing the mean of their places."""
    first = F.rank().over(Window.partitionBy(*within).orderBy(value))
    return first + (F.count(F.lit(1)).over(Window.partitionBy(*within, value)) - 1) / 2


def sign_test_p(agree: Column, tested: Column) -> Column:
    """Exact two-sided binomial p at one half."""
    m = F.greatest(agree, tested - agree)
    row = lambda n, k: F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda a, i: a * (n - k + i) / i)
    tail = F.aggregate(F.sequence(m.cast("int"), tested.cast("int")), F.lit(0.0), lambda a, k: a + row(tested, k))
    return F.when(tested > 0, F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), tested)))


def values_agree(quoted: Column, actual: Column, rtol: float = 0.02, atol: float = 5e-4) -> Column:
    """Numbers within the larger tolerance, or equal strings in any case."""
    q, a = quoted.try_cast("double"), actual.try_cast("double")
    return F.when(q.isNotNull() & a.isNotNull(), F.abs(q - a) <= F.greatest(F.lit(atol), rtol * F.abs(a))).otherwise(F.lower(F.trim(quoted)) == F.lower(F.trim(actual)))
