"""Column expressions shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrNumber = Column | str | float | int


def as_col(c: ColumnOrNumber) -> Column:
    """A name means a column, a number a literal."""
    if isinstance(c, str):
        return F.col(c)
    return c if isinstance(c, Column) else F.lit(float(c))


def total(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def every(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def any_of(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def known(*cols: str) -> Column:
    """Whether all of these columns have a value."""
    return every([F.col(c).isNotNull() for c in cols])


def largest(cols: Sequence[Column]) -> Column:
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def hash_number(*parts: Column) -> Column:
    """First 8 hex digits of md5 of the parts joined by ':', as a number below 2^32."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    """Repeatable pseudo-random number in [0, 1) made from the parts."""
    return hash_number(*parts) / F.lit(4294967296.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value, Abramowitz and Stegun formula 26.2.17 (error < 7.5e-8).

    NULL where z is NULL.
    """
    # fixed values of the published formula
    p = 0.2316419
    b = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
    a = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(p) * a)
    poly = reduce(lambda acc, c: (acc + F.lit(c)) * t, reversed(b), F.lit(0.0))
    tail = F.exp(-a * a / 2) / F.lit(2.5066282746310002) * poly
    return F.when(z.isNotNull(), F.least(F.lit(1.0), 2 * tail))


# Steps of the series and the continued fraction below; both settle far earlier for up to
# some thousand degrees of freedom.
_STEPS = 600


def _log_gamma_of_half(df: Column) -> Column:
    """log(gamma(df / 2)) for a whole number of degrees of freedom."""
    odd = F.pmod(df, F.lit(2))
    n = F.floor((df - 1) / 2).cast("int")
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    start = F.when(odd == 1, 0.5 * F.log(F.lit(math.pi))).otherwise(F.lit(0.0))
    return F.aggregate(steps, start, lambda acc, i: acc + F.log(i - odd / 2))


def chi2_tail(chi2: Column, df: Column) -> Column:
    """Probability of a chi-square value this large or larger, with `df` degrees of freedom.

    The upper incomplete gamma function: by its series below the mean, by its continued
    fraction (Lentz's method) above. NULL where an argument is NULL or df is below 1.
    """
    a, x = df.cast("double") / 2, chi2.cast("double") / 2
    steps = F.sequence(F.lit(1), F.lit(_STEPS))
    front = F.exp(a * F.log(x) - x - _log_gamma_of_half(df.cast("int")))

    def term(acc: Column, i: Column) -> Column:
        t = acc["t"] * x / (a + i)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    lower = F.aggregate(steps, F.struct((1 / a).alias("t"), (1 / a).alias("s")), term)["s"] * front

    def lentz(acc: Column, i: Column) -> Column:
        top, low = -i * (i - a), x + 1 - a + 2 * i
        d = 1 / (top * acc["d"] + low)
        c = low + top / acc["c"]
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))

    first = 1 / (x + 1 - a)
    start = F.struct(F.lit(1e300).alias("c"), first.alias("d"), first.alias("h"))
    upper = F.aggregate(steps, start, lentz)["h"] * front
    tail = F.when(x <= 0, F.lit(1.0)).when(x < a + 1, 1 - lower).otherwise(upper)
    return F.when((df >= 1) & chi2.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail)))
