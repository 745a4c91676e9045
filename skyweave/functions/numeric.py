"""Numeric column expressions that are safe under ANSI mode and treat NaN as missing."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAD_TO_SIGMA = 1.4826
FWHM_TO_SIGMA = 2.354820045


def finite(c: Column) -> Column:
    """The number, null if it is NaN, infinite or no number."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def rounded(c: Column, digits: int) -> Column:
    """To so many digits, halves away from 0, as DuckDB does; numbers without that many stay. Plain
    arithmetic: ``round`` goes through a decimal for every value."""
    unit = 10.0**digits
    y = c * unit
    return F.when(F.abs(y) < 2.0**52, F.signum(y) * F.floor(F.abs(y) + 0.5) / unit).otherwise(c)


def clip(c: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def clip01(c: Column) -> Column:
    """Into [0, 1]; missing counts as 0."""
    return F.coalesce(clip(finite(c), 0.0, 1.0), F.lit(0.0))


def snr_feature(flux: Column, unc: Column) -> Column:
    """Signal to noise in units of 50, clipped to -1 and 1; 0 without a positive uncertainty."""
    snr = F.when(finite(unc) > 0, finite(flux) / F.when(unc > 0, unc))
    return clip(F.coalesce(finite(snr), F.lit(0.0)), -50.0, 50.0) / 50.0


def robust_norm(value: Column, median: Column, scale: Column) -> Column:
    """Distance from the median in units of the scale, clipped to 12; 0 where it is missing."""
    return clip(F.coalesce(finite((value - median) / F.greatest(scale, F.lit(1e-6))), F.lit(0.0)), -12.0, 12.0)


def bilinear(image: Column, x: Column, y: Column) -> Column:
    """The value of a 2-D map (array of rows) between its pixel centres; null outside."""
    wide, high = F.size(image[0]), F.size(image)
    inside = (x >= 0) & (y >= 0) & (x <= wide - 1) & (y <= high - 1)
    x0, y0 = F.floor(x).cast("int"), F.floor(y).cast("int")
    x1, y1 = F.least(x0 + 1, wide - 1), F.least(y0 + 1, high - 1)
    dx, dy = x - x0, y - y0
    at = lambda j, i: F.get(F.get(image, j), i)
    value = at(y0, x0) * (1.0 - dx) * (1.0 - dy) + at(y0, x1) * dx * (1.0 - dy) + at(y1, x0) * (1.0 - dx) * dy + at(y1, x1) * dx * dy
    return F.when(inside, value)


def mask(bits: list[int]) -> int:
    out = 0
    for b in bits:
        out |= 1 << b
    return out


def has_bits(flags: Column, bits: list[int]) -> Column:
    return F.coalesce(flags.cast("long").bitwiseAND(F.lit(mask(bits))) != 0, F.lit(False))


def log10_positive(c: Column) -> Column:
    return F.when(c > 0, F.log10(c))


def general_format(c: Column) -> Column:
    """``%g`` with six digits for numbers of ordinary size: trailing zeros go, and so does the point."""
    magnitude = F.when(c == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(c)))).cast("int")
    fixed = F.coalesce(*(F.when(magnitude == m, F.format_string(f"%.{max(0, 5 - m)}f", F.bround(c, max(0, 5 - m)))) for m in range(-4, 6)))
    trimmed = F.when(fixed.contains("."), F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")).otherwise(fixed)
    return F.when(c.isNotNull(), F.coalesce(trimmed, c.cast("string")))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 by a Chebyshev fit (relative error below 1.2e-7)."""
    # Coefficients of the fit in Numerical Recipes, section 6.2.
    coefficients = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def p_local(q: Column) -> Column:
    """Chance of a score this high at one place."""
    return F.when(q > 0, 0.5 * erfc(F.sqrt(q / 2.0))).otherwise(0.5)


def p_global(q: Column, crossings: Column, level: Column) -> Column:
    """Bound on the chance of a score this high anywhere, from the crossings of a lower level."""
    tail = F.greatest(crossings, F.lit(0.0)) * F.exp(-0.5 * (q - level))
    return F.when(q > 0, F.least(F.lit(1.0), p_local(q) + tail)).otherwise(1.0)


def half_even(c: Column, scale: float = 1000.0) -> Column:
    return F.bround(c * scale, 0).cast("long")


SQRT_2PI = math.sqrt(2 * math.pi)

# Fixed value: micro-jansky for each square arcsecond of a megajansky a steradian.
MJY_SR_TO_UJY_ARCSEC2 = 23.50443053909789


def to_micro_jansky(value: Column, arcsec2: Column) -> Column:
    """Surface brightness (MJy/sr) times a pixel's solid angle, in micro-jansky."""
    return value * arcsec2 * MJY_SR_TO_UJY_ARCSEC2


def variance_to_micro_jansky(variance: Column, arcsec2: Column) -> Column:
    """The same for a variance: by the square of the factor."""
    return variance * F.pow(arcsec2 * MJY_SR_TO_UJY_ARCSEC2, 2)
