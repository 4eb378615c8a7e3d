"""Numeric expressions that Spark lacks, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 97.5 % quantile of the normal distribution.
Z975 = 1.959963984540054


def half_precision(x: Column) -> Column:
    """x rounded to IEEE half precision, ties to even, as a double; overflow is infinite, null stays null."""
    size = F.abs(x)
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.when(size > 0, size))), F.lit(-14)) - 10)
    rounded = F.rint(x / step) * step
    return F.when(size == 0, 0.0).when(size >= 65520, F.signum(x) * float("inf")).otherwise(rounded)


def half_bits(x: Column) -> Column:
    """The 16 bits of x in half precision, as a short."""
    y = half_precision(x)
    size = F.abs(y)
    exponent = F.greatest(F.floor(F.log2(F.when(size > 0, size))), F.lit(-14))
    bits = (exponent + 14) * 1024 + size / F.pow(F.lit(2.0), exponent - 10)
    bits = F.when(F.isnan(y), 32256).when(size == 0, 0).when(size > 65504, 31744).otherwise(bits).cast("int")
    return F.when(y < 0, bits - 32768).otherwise(bits).cast("short")


def half_of_bits(bits: Column) -> Column:
    """The number whose half precision has these 16 bits, as a double."""
    part = F.when(bits < 0, bits.cast("int") + 32768).otherwise(bits.cast("int"))
    exponent, fraction = F.floor(part / 1024), part % 1024
    size = F.when(exponent == 0, fraction * F.lit(2.0**-24)).when(exponent < 31, (1024 + fraction) * F.pow(F.lit(2.0), exponent - 25)).when(fraction == 0, float("inf")).otherwise(float("nan"))
    return F.when(bits < 0, -size).when(bits.isNotNull(), size)


def kolmogorov_sf(x: Column) -> Column:
    """Survival function of the Kolmogorov distribution; 1 below 0.2, where the series converges slowly."""
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * x * x))
    total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def erfc(z: Column) -> Column:
    """Complementary error function for z >= 0: the power series below 0.5, Craig's integral by 64 midpoints from there."""
    k = F.sequence(F.lit(0), F.lit(24))
    # z^(2k+1) 2^k / (1 * 3 * ... * (2k+1)), built term by term
    step = F.aggregate(k, F.struct(F.lit(0.0).alias("s"), z.cast("double").alias("t")), lambda a, i: F.struct((a["s"] + a["t"]).alias("s"), (a["t"] * 2 * z * z / (2 * i + 3)).alias("t")))
    series = 1 - 2 / F.sqrt(F.lit(3.141592653589793)) * F.exp(-z * z) * step["s"]
    sines = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.sin((i + 0.5) * 3.141592653589793 / 128))
    craig = F.aggregate(F.transform(sines, lambda s: F.exp(-z * z / (s * s))), F.lit(0.0), lambda a, t: a + t) / 64
    return F.when(z < 0.5, series).otherwise(craig)


def chi2_sf1(g: Column) -> Column:
    """Survival function of chi-squared with one degree of freedom."""
    return erfc(F.sqrt(F.greatest(g, F.lit(0.0)) / 2))


def general(x: Column, digits: int = 2) -> Column:
    """x with so many significant digits, without trailing zeros, as %g prints it in C: 0.5, 1, 1e-05, nan."""
    text = F.format_string(f"%.{digits - 1}e", x)
    exponent = F.regexp_extract(text, "e([+-][0-9]+)$", 1).cast("int")
    short = F.regexp_replace(F.regexp_replace(text, "e.*$", ""), r"\.?0+$", "")
    mantissa = F.when(text.contains("."), short).otherwise(F.regexp_replace(text, "e.*$", ""))
    rounded = F.expr("1") * text.cast("double")
    places = F.greatest(digits - 1 - exponent, F.lit(0))
    fixed = F.format_string("%.10f", rounded)
    fixed = F.regexp_replace(F.regexp_replace(fixed, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    scientific = F.concat(mantissa, F.regexp_extract(text, "(e[+-])", 1), F.lpad(F.regexp_extract(text, "e[+-]0*([0-9]+)$", 1), 2, "0"))
    small = (exponent < -4) | (exponent >= digits)
    return F.when(x.isNull() | F.isnan(x), "nan").when(x == 0, "0").when(small, scientific).when(places >= 0, fixed)
