"""Number helpers shared by the operators."""

from __future__ import annotations

from functools import lru_cache
from math import atan, cos, pi, sin, sqrt
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL_DOF = 200


def ieee_divide(num: Column, den: Column) -> Column:
    """Division that keeps the infinities and NaN of floating point instead of failing on zero."""
    by_zero = (F.when(num > 0, F.lit(float("inf"))).when(num < 0, F.lit(float("-inf")))
               .when(num.isNotNull(), F.lit(float("nan"))))
    return F.when(den == 0, by_zero).otherwise(F.try_divide(num, den))


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low)))


def _two_sided(t: float, dof: int) -> float:
    """P(|T| < t) for integer degrees of freedom, by the finite trigonometric sum."""
    theta = atan(t / sqrt(dof))
    c2 = cos(theta) ** 2
    term, total = 1.0, 1.0
    if dof % 2:
        if dof == 1:
            return 2 * theta / pi
        for k in range(2, dof - 1, 2):
            term *= c2 * k / (k + 1)
            total += term
        return 2 / pi * (theta + sin(theta) * cos(theta) * total)
    for k in range(1, dof - 1, 2):
        term *= c2 * k / (k + 1)
        total += term
    return sin(theta) * total


@lru_cache(maxsize=None)
def t_quantile(dof: int, alpha: float = 0.05) -> float:
    """1 - alpha/2 quantile of Student's t, by bisection."""
    low, high = 0.0, 1.0
    while _two_sided(high, dof) < 1 - alpha:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if _two_sided(mid, dof) < 1 - alpha:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def t_critical(dof: Column, alpha: float = 0.05) -> Column:
    """The same quantile as a column: a literal table, then its series in 1/dof."""
    table = F.array(*[F.lit(t_quantile(d, alpha)) for d in range(1, SMALL_DOF + 1)])
    z = NormalDist().inv_cdf(1 - alpha / 2)
    series = [  # expansion of the quantile around the normal one
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    inverse = F.try_divide(F.lit(1.0), dof.cast("double"))
    large = F.lit(z)
    for power, weight in enumerate(series, 1):
        large = large + F.lit(weight) * F.pow(inverse, F.lit(float(power)))
    return F.when(dof <= SMALL_DOF, F.try_element_at(table, dof.cast("int"))).otherwise(large)


def mean_est(value: Column, alpha: float = 0.05, std_error: bool = False) -> dict[str, Column]:
    """Aggregates (val, err, n): mean and its spread at significance ``alpha``.

    The error is std * t, as the reported tables expect; ``std_error`` divides
    it by sqrt(n).  A single value has an infinite error.
    """
    n = F.count(value)
    err = F.stddev_samp(value) * t_critical(n - 1, alpha)
    if std_error:
        err = err / F.sqrt(n)
    return {
        "val": F.avg(value),
        "err": F.when(n > 1, err).when(n == 1, F.lit(float("inf"))),
        "n": n,
    }


def ratio_err(num: Column, num_err: Column, den: Column, den_err: Column) -> Column:
    """Error of num/den for independent errors."""
    q = F.try_divide(num, den)
    return F.abs(q) * F.sqrt(F.pow(F.try_divide(num_err, num), F.lit(2.0)) + F.pow(F.try_divide(den_err, den), F.lit(2.0)))


def general_format(value: Column, digits: int = 6) -> Column:
    """Six (or ``digits``) significant digits with trailing zeros removed, like C's %g."""
    # The exponent is that of the rounded value: 999999.5 prints as 1e+06.
    text = F.format_string(f"%.{digits - 1}e", value)
    exponent = F.when(value == 0, F.lit(0)).otherwise(F.regexp_extract(text, "e(.*)$", 1).cast("int"))
    mantissa = F.regexp_replace(F.regexp_extract(text, "^(.*)e", 1), r"\.?0+$", "")
    scientific = F.concat(mantissa, F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
                          F.format_string("%02d", F.abs(exponent)))
    fixed = F.element_at(F.array(*[F.format_string(f"%.{d}f", value) for d in range(0, 10)]),
                         (F.greatest(F.least(digits - 1 - exponent, F.lit(9)), F.lit(0)) + 1).cast("int"))
    fixed = F.when(F.instr(fixed, ".") > 0, F.regexp_replace(fixed, r"\.?0+$", "")).otherwise(fixed)
    return (F.when(value.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(value), F.lit("nan"))
            .when(value == float("inf"), F.lit("inf")).when(value == float("-inf"), F.lit("-inf"))
            .when((exponent < -4) | (exponent >= digits), scientific).otherwise(fixed))
