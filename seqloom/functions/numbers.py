"""Number helpers: sizes in bits, odd sizes, powers, log-gamma, binomials and log-sums."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients for g = 7, n = 9.
LANCZOS_G = 7
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bits_for(n) -> Column:
    """Bits that tell n states apart (the least b with 2**b >= n, 0 for one state)."""
    n = _col(n).cast("bigint")
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def fractional_bits_for(n) -> Column:
    return F.log2(_col(n).cast("double"))


def next_power(n) -> Column:
    """The least power of two that is n or more."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bits_for(n))


def previous_power(n) -> Column:
    """The greatest power of two that is n or less; n is 1 or more."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(_col(n).cast("bigint"))) - 1)


def next_odd(n) -> Column:
    """The least odd integer that is n or more."""
    up = F.ceil(_col(n)).cast("bigint")
    return up.bitwiseOR(F.lit(1).cast("bigint"))


def log_gamma(x) -> Column:
    """ln of the gamma function by the Lanczos series, for x > 0."""
    z = _col(x).cast("double") - 1
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + i)
    t = z + LANCZOS_G + 0.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(series)


def log_binomial(n, k) -> Column:
    """ln of n over k, minus infinity outside 0 <= k <= n."""
    n, k = _col(n), _col(k)
    inside = (k >= 0) & (k <= n) & (n >= 0)
    value = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)
    return F.when(inside, F.when((k == 0) | (k == n), 0.0).otherwise(value)).otherwise(float("-inf"))


def log_sum2(x, y) -> Column:
    """ln(exp(x) + exp(y)) without overflow."""
    high, low = F.greatest(_col(x), _col(y)), F.least(_col(x), _col(y))
    return F.when(high == float("-inf"), high).otherwise(high + F.log1p(F.exp(low - high)))


def log_sum(df, group: list[str], value: str, name: str = "logsum"):
    """ln of the sum of exp(value) by group, in one aggregation after the group's greatest value."""
    top = df.groupBy(*group).agg(F.max(value).alias("_top"))
    joined = df.join(top, group) if group else df.crossJoin(F.broadcast(top))
    shifted = F.when(F.col("_top") == float("-inf"), 0.0).otherwise(F.exp(F.col(value) - F.col("_top")))
    total = joined.groupBy(*group, "_top").agg(F.sum(shifted).alias("_sum"))
    return total.select(*group, (F.col("_top") + F.when(F.col("_sum") > 0, F.log("_sum")).otherwise(0.0)).alias(name))


def inverse(a: int, modulus: int) -> int:
    """The inverse of a; ValueError if there is none."""
    return pow(a, -1, modulus)
