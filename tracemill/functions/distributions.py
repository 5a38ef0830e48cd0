"""Distribution functions as native column expressions: the incomplete beta and gamma functions by continued fractions and
series in higher-order functions, tails of the usual tests, and quantiles by bisection. Own definitions; the formulas are
textbook ones. Results are within 1e-9 of tabulated values. A null argument gives null, one outside the domain too.

Work a row is some tens of steps and grows with the root of the parameters; these are for one row a test, not a row a record."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keeps the fractions' denominators off zero.
TINY = 1e-300
HALVINGS = 60


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fields(body: Callable[..., Column], **values: Column) -> Column:
    return _let(F.struct(*[v.cast("double").alias(k) for k, v in values.items()]), lambda s: body(*[s[k] for k in values]))


def log_gamma(x: Column) -> Column:
    """Stirling's series eight places up, brought back down; for x > 0."""
    y = x + 8
    series = sum((F.lit(c) / F.pow(y, F.lit(float(p))) for c, p in ((1 / 12, 1), (-1 / 360, 3), (1 / 1260, 5), (-1 / 1680, 7), (1 / 1188, 9), (-691 / 360360, 11))), F.lit(0.0))
    down = F.ln(x)
    for k in range(1, 8):
        down = down + F.ln(x + k)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - down


def _off_zero(x: Column) -> Column:
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def _fraction(terms: Column) -> Column:
    """1 + t1 / (1 + t2 / (1 + ...)) for an array of t, by the modified Lentz method."""
    start = F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("d"), F.lit(1.0).alias("f"))

    def step(s: Column, t: Column) -> Column:
        pair = F.struct(_off_zero(1 + t / s["c"]).alias("c"), (1 / _off_zero(1 + t * s["d"])).alias("d"))
        return _let(pair, lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (s["f"] * n["c"] * n["d"]).alias("f")))

    return F.aggregate(terms, start, step, lambda s: s["f"])


def _steps(size: Column) -> Column:
    return F.sequence(F.lit(1), (40 + 6 * F.sqrt(size)).cast("int"))


def _beta_below(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function where the fraction converges fast: x < (a + 1) / (a + b + 2)."""

    def term(j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(j % 2 == 0, even).otherwise(odd)

    front = F.exp(a * F.ln(x) + b * F.log1p(-x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) / a
    return front / _fraction(F.transform(_steps(F.greatest(a, b)), term))


def beta_cdf(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b), for a, b > 0."""

    def whole(x: Column, a: Column, b: Column) -> Column:
        low = x < (a + 1) / (a + b + 2)
        swapped = _fields(_beta_below, x=F.when(low, x).otherwise(1 - x), a=F.when(low, a).otherwise(b), b=F.when(low, b).otherwise(a))
        inside = F.when(low, swapped).otherwise(1 - swapped)
        return F.when((a <= 0) | (b <= 0), F.lit(None)).when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)

    return _fields(whole, x=x, a=a, b=b)


def beta_quantile(p: Column, a: Column, b: Column) -> Column:
    """x with I_x(a, b) = p, by bisection."""

    def whole(p: Column, a: Column, b: Column) -> Column:
        ends = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))

        def halve(s: Column, _: Column) -> Column:
            mid = F.struct(s["low"].alias("low"), s["high"].alias("high"), ((s["low"] + s["high"]) / 2).alias("mid"))
            side = lambda m: F.when(beta_cdf(m["mid"], a, b) < p, F.struct(m["mid"].alias("low"), m["high"].alias("high"))).otherwise(F.struct(m["low"].alias("low"), m["mid"].alias("high")))
            return _let(mid, side)

        found = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), ends, halve, lambda s: (s["low"] + s["high"]) / 2)
        return F.when((a > 0) & (b > 0) & p.between(0, 1), found)

    return _fields(whole, p=p, a=a, b=b)


def gamma_tail(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function Q(a, x), for a > 0."""

    def whole(a: Column, x: Column) -> Column:
        front = F.exp(a * F.ln(x) - x - log_gamma(a))
        # Below a + 1: one minus the series of terms x^n / (a (a + 1) ... (a + n)).
        start = F.struct((1 / a).alias("t"), (1 / a).alias("s"))
        grow = lambda s, n: _let(s["t"] * x / (a + n), lambda t: F.struct(t.alias("t"), (s["s"] + t).alias("s")))
        series = F.aggregate(_steps(4 * F.greatest(a, x)), start, grow, lambda s: s["s"])
        # Above: the fraction 1 / (x + (1 - a) / (1 + 1 / (x + (2 - a) / (1 + 2 / (x + ...))))), with denominators made 1.
        term = lambda j: F.when(j % 2 == 1, ((j + 1) / 2 - a) / x).otherwise((j / 2) / x)
        fraction = 1 / (x * _fraction(F.transform(_steps(16 * F.greatest(a, F.lit(100.0))), term)))
        return F.when(a <= 0, F.lit(None)).when(x <= 0, 1.0).when(x < a + 1, 1 - front * series).otherwise(front * fraction)

    return _fields(whole, a=a, x=x)


def chi_square_p(statistic: Column, df: Column) -> Column:
    """Probability of so large a statistic. Null for no degrees of freedom."""
    return gamma_tail(df.cast("double") / 2, statistic / 2)


def normal_p(z: Column) -> Column:
    """Two-sided probability of so large a deviate."""
    return gamma_tail(F.lit(0.5), z * z / 2)


def t_p(t: Column, df: Column) -> Column:
    """Two-sided probability of so large a Student's t."""
    return beta_cdf(df / (df + t * t), df / 2, F.lit(0.5))


def binomial_interval(k: Column, n: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """The exact (Clopper and Pearson's) bounds of a share of k in n."""
    low = F.when(k == 0, 0.0).otherwise(beta_quantile(F.lit(alpha / 2), k, n - k + 1))
    high = F.when(k == n, 1.0).otherwise(beta_quantile(F.lit(1 - alpha / 2), k + 1, n - k))
    return low, high
