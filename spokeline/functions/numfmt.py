"""Number formats: exact fixed decimals, rounding with ties upwards, lenient parsing, distances and times in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_MILE, FEET_PER_METRE, METRES_PER_TENTH_MILE = 1609.34, 3.281, 160.934


def to_fixed(x: Column, digits: int) -> Column:
    """Text with so many decimals, rounded from the exact binary value with ties away from zero.

    The fraction is scaled to an integer of 49 bits (59 for one digit), which is exact for |x| >= 8 (2^-7), and rounded there.
    """
    bits = {4: 49, 1: 59}.get(digits, 49)
    a = F.abs(x)
    i = ((a - F.floor(a)) * F.lit(float(1 << bits))).cast("long")
    ten = 10**digits
    n = F.shiftright(i * F.lit(ten).cast("long") + F.lit(1 << (bits - 1)), bits)
    whole = F.floor(a).cast("long") + F.floor(n / ten).cast("long")
    fraction = F.concat(F.lit("."), F.lpad((n % ten).cast("string"), digits, "0")) if digits else F.lit("")
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), whole.cast("string"), fraction)


def round_half_up(x: Column) -> Column:
    """The nearest integer, ties towards plus infinity."""
    return F.floor(x + 0.5).cast("long")


def leading_number(s: Column) -> Column:
    """The number that a text starts with ('12abc' is 12), null if none."""
    lead = F.regexp_extract(s, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(lead != "", lead.try_cast("double"))


def number_or(s: Column, fallback: Column) -> Column:
    """The leading number of a text; what is missing, no number or zero falls back."""
    n = leading_number(s)
    return F.when(n.isNotNull() & (n != 0) & ~F.isnan(n), n).otherwise(fallback)


def whole(x: Column) -> Column:
    return round_half_up(x).cast("string")


def distance_text(m: Column) -> Column:
    return F.when(m < 160, F.concat(whole(m), F.lit(" m"))).otherwise(F.concat(to_fixed(m / METRES_PER_MILE, 1), F.lit(" mi")))


def nav_distance_text(m: Column) -> Column:
    feet, miles = round_half_up(m * FEET_PER_METRE), m / METRES_PER_MILE
    tens = (round_half_up(feet / 10) * 10).cast("string")
    fifties = (round_half_up(feet / 50) * 50).cast("string")
    return (
        F.when(m < 15, F.lit("Now")).when(feet <= 500, F.concat(tens, F.lit(" ft"))).when(miles < 0.15, F.concat(fifties, F.lit(" ft")))
        .otherwise(F.concat(to_fixed(miles, 1), F.lit(" mi")))
    )


def duration_text(s: Column) -> Column:
    minutes = round_half_up(s / 60)
    return (
        F.when(s < 60, F.lit("<1 min")).when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
        .otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m")))
    )


def voice_distance_text(m: Column) -> Column:
    feet = round_half_up(m * FEET_PER_METRE)
    tenths = round_half_up(m / METRES_PER_TENTH_MILE)
    return (
        F.when(m < 30, F.lit("a few yards")).when(feet <= 200, F.concat((round_half_up(feet / 10) * 10).cast("string"), F.lit(" feet")))
        .when(tenths <= 1, F.lit("a tenth of a mile")).otherwise(F.concat(tenths.cast("string"), F.lit(" tenths of a mile")))
    )
