"""Numeric helpers: exact two-digit rounding, percentages, log-odds, smoothed rates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

FRACTION_BITS = 52


def round_binary(value: Column, digits: int = 2) -> Column:
    """Round to ``digits`` (at most 2) by the value a double really holds.

    ``bround`` rounds the shortest decimal text, so 2.675 (stored just below the tie) goes up.
    Here the fraction is taken as an integer count of 2**-52 and compared with the half exactly;
    true ties go to the even digit."""
    scale, unit = 10**digits, 2**FRACTION_BITS
    size = F.abs(value)
    whole = F.floor(size)
    scaled = (size - whole) * F.lit(float(unit))
    count = F.floor(scaled)
    below = (scaled - count) * scale
    total = count * scale + F.floor(below)
    digit = F.shiftright(total, FRACTION_BITS)
    rest = total - F.shiftleft(digit, FRACTION_BITS)
    half = F.lit(unit // 2)
    even = whole * scale + digit
    tie = (rest == half) & (below == F.floor(below))
    up = F.when(tie, even.bitwiseAND(F.lit(1))).otherwise((rest >= half).cast("long"))
    return F.signum(value) * ((even + up) / F.lit(float(scale)))


def pct(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    """Rounded percentage, null when the denominator is zero or null."""
    return round_binary(F.try_divide((100 * numerator).cast("double"), denominator.cast("double")), digits)


def clip(value: Column, eps: float) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1 - eps), value))


def log_odds(probability: Column, eps: float = 1e-6) -> Column:
    p = clip(probability, eps)
    return F.log(p / (1 - p))


def smoothed_rate(hits: Column, trials: Column) -> Column:
    return (hits + 1) / (trials + 2)
