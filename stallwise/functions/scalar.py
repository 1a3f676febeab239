"""Rounding, clamping, snapping and text comparison, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean a missing value once normalised.
MISSING_TEXTS = ("", "na", "none", "unknown")


def half_up(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(x + 0.5).cast("long")


def scaled(x: Column, by: int = 1_000_000) -> Column:
    """A fraction as an integer of parts in ``by``."""
    return half_up(x * by)


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def snap_step(minor: Column) -> Column:
    """Grid of charm prices in minor units: 10 rupees under 1,000, 50 under 10,000, else 100."""
    return F.when(minor < 100_000, 1000).when(minor < 1_000_000, 5000).otherwise(10_000).cast("long")


def psych_snap(minor: Column, low: Column, high: Column) -> Column:
    """The charm price (one rupee under the grid) at or under ``minor``, lifted to ``low``, kept under ``high``, else ``high`` itself."""
    step = snap_step(minor)
    x = F.greatest(F.floor(minor / step) * step - 100, F.lit(100))
    up = x + step * F.greatest(F.ceil((low - x) / step), F.lit(0))
    down = F.when(up > high, up - step * F.ceil((up - high) / step)).otherwise(up)
    return F.when(down < low, half_up(high.cast("double"))).when(down > high, half_up(high.cast("double"))).otherwise(down).cast("long")


def normal_text(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def token_jaccard(a: Column, b: Column) -> Column:
    p, q = F.array_distinct(F.split(normal_text(a), " ")), F.array_distinct(F.split(normal_text(b), " "))
    return F.size(F.array_intersect(p, q)) / F.size(F.array_union(p, q))


def numeric_closeness(a: Column, b: Column) -> Column:
    return 1 - F.least(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1)), F.lit(1.0))


def price_proximity(a: Column, b: Column) -> Column:
    """1 for equal prices, 0 from a factor of three on, and for a missing or zero price."""
    known = (F.coalesce(a, F.lit(0)) > 0) & (F.coalesce(b, F.lit(0)) > 0)
    return F.when(known, 1 - F.least(F.abs(F.ln(a / b)) / F.ln(F.lit(3.0)), F.lit(1.0))).otherwise(0.0)


def model_name(name: Column, brand: Column) -> Column:
    """A name up to its first bracket or dash, without its brand in front."""
    head = F.trim(F.substring_index(F.substring_index(name, "(", 1), "—", 1))
    return F.when(F.startswith(F.lower(head), F.lower(F.concat(brand, F.lit(" ")))), F.trim(F.substring(head, F.length(brand) + 1, F.length(head)))).otherwise(head)


def compact_money(minor: Column) -> Column:
    """Rupees with a suffix: L for lakhs with two decimals, k for thousands with one; halves go up, null is a dash."""
    part = lambda by, digits: F.concat(F.floor(half_up(minor / by) / 10**digits).cast("string"), F.lit("."), F.lpad((half_up(minor / by) % 10**digits).cast("string"), digits, "0"))
    text = F.when(minor >= 10_000_000, F.concat(part(100_000, 2), F.lit("L"))).when(minor >= 100_000, F.concat(part(10_000, 1), F.lit("k"))).otherwise(half_up(minor / 100).cast("string"))
    return F.when(minor.isNull(), "—").otherwise(F.concat(F.lit("₹"), text))


def grouped_money(minor: Column) -> Column:
    """Whole rupees with Indian grouping: three digits, then pairs; null is a dash."""
    rupees = half_up(F.abs(minor) / 100).cast("string")
    sign = F.when(minor < 0, "-").otherwise("")
    return F.when(minor.isNull(), "—").otherwise(F.concat(sign, F.lit("₹"), F.regexp_replace(rupees, r"(\d)(?=(\d\d)+\d$)", "$1,")))


def percent_label(bp: Column, signed: bool = False) -> Column:
    """Basis points as a percentage with one decimal, halves away from zero, with a plus sign if asked for; null is a dash."""
    tenths = half_up(F.abs(bp) / 10)
    sign = F.when(bp < 0, "-").when((bp > 0) & F.lit(signed), "+").otherwise("")
    return F.when(bp.isNull(), "—").otherwise(F.concat(sign, F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%")))


def age_label(then: Column, now: Column) -> Column:
    """How long ago: minutes below an hour, hours below a day, else days, each rounded from the one before, halves up; null is a dash."""
    minutes = half_up((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 60_000_000)
    hours = half_up(minutes / 60)
    told = F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).when(hours < 24, F.concat(hours.cast("string"), F.lit("h"))).otherwise(F.concat(half_up(hours / 24).cast("string"), F.lit("d")))
    return F.when(then.isNull(), "—").otherwise(F.concat(told, F.lit(" ago")))


def day_label(day: Column, year: bool = True) -> Column:
    """A day as 4 Jan 2024, or without its year; null is a dash."""
    return F.coalesce(F.date_format(day, "d MMM yyyy" if year else "d MMM"), F.lit("—"))


def moment_label(at: Column) -> Column:
    """A moment as 4 Jan 2024, 05:30 pm; null is a dash."""
    return F.coalesce(F.concat(F.date_format(at, "d MMM yyyy, hh:mm "), F.lower(F.date_format(at, "a"))), F.lit("—"))
