"""Intervals of proportions, design effects, and sample sizes; columns for tables, floats for plans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two-sided normal quantiles.
Z = {0.90: 1.6448536269514722, 0.95: 1.959963984540054, 0.99: 2.5758293035489004}
SMALL_GROUP = 20


def wilson(successes: Column, n: Column, confidence: float = 0.95, deff: Column | float = 1.0) -> Column:
    """struct(p, lower, upper, small) by Wilson's score interval, null without trials. A design effect divides the trials."""
    z = Z[confidence]
    p = (successes / F.when(n > 0, n)).cast("double")
    e = n / (deff if isinstance(deff, Column) else F.lit(deff))
    d = 1 + z * z / e
    centre, half = (p + z * z / (2 * e)) / d, z / d * F.sqrt(p * (1 - p) / e + z * z / (4 * e * e))
    lower, upper = F.greatest(F.lit(0.0), F.least(p, centre - half)), F.least(F.lit(1.0), F.greatest(p, centre + half))
    return F.when(n > 0, F.struct(p.alias("p"), lower.alias("lower"), upper.alias("upper"), (n < SMALL_GROUP).alias("small")))


def design_effect(groups: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(clusters, n, successes, rho, deff) from one row per cluster (size, successes), by ANOVA intra-class correlation.

    Five sums per group tell it all, so clusters never meet. rho is held within 0 and 1; with fewer than two clusters, only
    single members, or no variance the effect is 1.
    """
    m, y = F.col("size").cast("double"), F.col("successes").cast("double")
    sums = groups.groupBy(*(by or [])).agg(
        F.count("*").alias("clusters"), F.sum(m).alias("n"), F.sum(y).alias("successes"), F.sum(m * m).alias("m2"), F.sum(y * y / m).alias("between"), F.sum(y - y * y / m).alias("within")
    )
    k, n, s = F.col("clusters"), F.col("n"), F.col("successes")
    msb = (F.col("between") - s * s / n) / F.when(k > 1, k - 1)
    msw = F.col("within") / F.when(n > k, n - k)
    m0 = (n - F.col("m2") / n) / F.when(k > 1, k - 1)
    under = msb + (m0 - 1) * msw
    rho = F.when((k < 2), 1.0).when(n == k, 0.0).when(under == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (msb - msw) / F.when(under != 0, under))))
    return sums.withColumn("rho", rho).withColumn("deff", F.when(n > 0, 1 + (F.col("m2") / n - 1) * F.col("rho"))).drop("m2", "between", "within")


def normal_quantile(p: float) -> float:
    """Inverse of the standard normal distribution, by Newton steps on the error function."""
    if not 0 < p < 1:
        raise ValueError("a probability lies between 0 and 1")
    x = 0.0
    for _ in range(100):
        step = (0.5 * math.erfc(-x / math.sqrt(2)) - p) * math.sqrt(2 * math.pi) * math.exp(min(x * x / 2, 700))
        x -= max(-1.0, min(1.0, step))
        if abs(step) < 1e-14:
            break
    return x


def required_units(p1: float, p2: float, alpha: float = 0.05, power: float = 0.8, deff: float = 1.0) -> int | None:
    """Units per arm that tell two proportions apart; none can if they are equal."""
    if p1 == p2:
        return None
    a, b, mean = normal_quantile(1 - alpha / 2), normal_quantile(power), (p1 + p2) / 2
    core = a * math.sqrt(2 * mean * (1 - mean)) + b * math.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    return math.ceil(core**2 / (p1 - p2) ** 2 * deff)


def detectable_reduction(p: float, units: int, alpha: float = 0.05, power: float = 0.8, deff: float = 1.0) -> float | None:
    """The least relative reduction of ``p`` that ``units`` per arm show, by bisection; none if even its end would not."""

    def enough(reduction: float) -> bool:
        need = required_units(p, p * (1 - reduction), alpha, power, deff)
        return need is not None and need <= units

    if p <= 0 or not enough(1.0):
        return None
    low, high = 0.0, 1.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (low, middle) if enough(middle) else (middle, high)
    return high


def power_verdict(p: float, units: int, reduction: float, **how) -> str:
    need = required_units(p, p * (1 - reduction), **how)
    return "impossible" if need is None else "enough" if need <= units else "short"


def median_of(values: Column) -> Column:
    """Exact median, the mean of the middle two; 0 without values."""
    return F.coalesce(F.percentile(values, F.lit(0.5)), F.lit(0.0))


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d, c = 1 / (an * d + b or tiny), b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_p(statistic: float | None, df: int | None) -> float | None:
    """Upper tail of the chi-square distribution."""
    return None if statistic is None or not df or df <= 0 else gamma_tail(df / 2, statistic / 2)
