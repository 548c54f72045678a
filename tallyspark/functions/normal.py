"""Standard normal distribution as a column expression, so tests of significance stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the normal integral (Hart et al., "Computer
# Approximations", 1968; double precision, published again by G. West, Wilmott 2005).
HART_NUMERATOR = (
    0.0352624965998911,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
HART_DENOMINATOR = (
    0.0883883476483184,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
HART_SWITCH = 7.07106781186547
# Terms of the continued fraction beyond the switch; enough for double precision there.
FRACTION_TERMS = 20
SQRT_2_PI = 2.5066282746310002
# Fixed value: 97.5 % point of the standard normal.
Z_975 = 1.959963984540054


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def _fraction(x: Column) -> Column:
    """Laplace's continued fraction of the tail over the density, from its far end."""
    return reduce(lambda rest, k: x + F.lit(float(k)) / rest, range(FRACTION_TERMS, 0, -1), x)


def normal_tail(z: Column) -> Column:
    """P(Z > |z|), by a rational approximation near zero and a continued fraction far out."""
    x = F.abs(z)
    density = F.exp(-x * x / 2)
    near = density * _horner(HART_NUMERATOR, x) / _horner(HART_DENOMINATOR, x)
    return F.when(x < HART_SWITCH, near).otherwise(density / (F.lit(SQRT_2_PI) * _fraction(x)))


def norm_cdf(z: Column) -> Column:
    """P(Z <= z)."""
    tail = normal_tail(z)
    return F.when(z > 0, 1 - tail).otherwise(tail)
