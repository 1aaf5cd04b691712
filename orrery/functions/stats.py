"""Distribution functions as Spark Columns.

Neither Spark nor DuckDB has ``erf``; the normal CDF uses West's published
double-precision rational approximation (Hart 1968): a degree 6/7 polynomial
ratio below |z| = 7.07 and a continued fraction above it, error about 1e-16.
It is generated as SQL text from one helper so the same expression can run in
Spark (``F.expr``) and in the DuckDB oracle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import c

SQRT_2PI = math.sqrt(2.0 * math.pi)
CI95_Z = 1.96  # fixed value: a 95 % interval is +-1.96 standard deviations

# Hart / West coefficients of the normal CDF approximation.
CDF_NUM = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
CDF_DEN = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]
CDF_SPLIT = 7.07106781186547
CDF_TAIL_SHIFT = 0.65
CDF_TAIL_DIV = 2.506628274631

# Standard normal quantiles of 10 %, 25 %, 50 %, 75 %, 90 %.
PERCENTILE_Z = {
    10: -1.2815515655446004,
    25: -0.6744897501960817,
    50: 0.0,
    75: 0.6744897501960817,
    90: 1.2815515655446004,
}


def sql_num(x: float) -> str:
    """A double literal both Spark SQL and DuckDB read as DOUBLE."""
    r = repr(float(x))
    return r if ("e" in r or "E" in r) else r + "E0"


def _horner(coefs: list[float], a: str) -> str:
    expr = sql_num(coefs[0])
    for k in coefs[1:]:
        expr = f"({expr} * {a} + {sql_num(k)})"
    return expr


def normal_cdf_sql(z: str) -> str:
    """SQL text of the standard normal CDF of the expression ``z`` (a column name
    or parenthesised expression)."""
    a = f"abs({z})"
    e = f"exp(-{a} * {a} / {sql_num(2.0)})"
    tail = f"({a} + {sql_num(CDF_TAIL_SHIFT)})"
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = f"({a} + {sql_num(k)} / {tail})"
    core = (
        f"CASE WHEN {a} < {sql_num(CDF_SPLIT)} "
        f"THEN {e} * {_horner(CDF_NUM, a)} / {_horner(CDF_DEN, a)} "
        f"ELSE {e} / {tail} / {sql_num(CDF_TAIL_DIV)} END"
    )
    return f"(CASE WHEN {z} > 0 THEN 1 - ({core}) ELSE ({core}) END)"


def normal_cdf(z) -> Column:
    """Standard normal CDF of a Column (expects a named column or SQL text)."""
    if isinstance(z, str):
        return F.expr(normal_cdf_sql(z))
    raise TypeError("normal_cdf takes a column name; add the z column first")


def normal_pdf(x, mu, sd) -> Column:
    """Density of N(mu, sd^2) at x."""
    z = (c(x) - c(mu)) / c(sd)
    return F.exp(-(z * z) / 2.0) / F.lit(SQRT_2PI) / c(sd)


def ci_to_sigma(ci_low, ci_high, z: float = CI95_Z) -> Column:
    """Standard deviation from a 95 % interval, (high - low) / (2 * 1.96)."""
    return (c(ci_high) - c(ci_low)) / F.lit(2 * z)


def lognormal_pdf(x, shape, log_scale) -> Column:
    """Density of a lognormal with shape ``s`` and scale ``exp(log_scale)`` at x > 0."""
    scale = F.exp(c(log_scale))
    y = c(x) / scale
    ly = F.log(y)
    return F.exp(-(ly * ly) / (c(shape) * c(shape) * 2.0)) / (c(shape) * y * F.lit(SQRT_2PI)) / scale


def lognormal_pdf_shifted(x, origin, shape, log_scale) -> Column:
    """Lognormal density of ``x - origin``, 0 at or before the origin (P10)."""
    t = c(x) - c(origin)
    return F.when(t > 0, lognormal_pdf(t, shape, log_scale)).otherwise(F.lit(0.0))
