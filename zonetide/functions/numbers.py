"""Number parsing, guarded ratios, scores and scaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_number(col: Column | str, default: float | None = 0.0) -> Column:
    """Text with a decimal comma or point; anything unreadable -> ``default``."""
    number = F.regexp_replace(F.trim(_c(col).cast("string")), ",", ".").try_cast("double")
    number = F.when(~F.isnan(number), number)
    return number if default is None else F.coalesce(number, F.lit(default))


def ratio(num: Column, den: Column) -> Column:
    """num / den, null when the divisor is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def percent_change(now: Column, base: Column, mode: str = "null") -> Column:
    """Percent change with one of three rules for a zero base.

    ``null``: null; ``hundred``: 100 when something appeared, else 0;
    ``unit``: the divisor is at least 1.
    """
    change = ratio((now - base) * 100.0, base)
    if mode == "null":
        return change
    if mode == "hundred":
        return F.when(base > 0, change).when(now > 0, 100.0).otherwise(0.0)
    if mode == "unit":
        return (now - base) * 100.0 / F.greatest(base.cast("double"), F.lit(1.0))
    raise ValueError(f"unknown mode {mode!r}")


def clip(col: Column, low: float, high: float) -> Column:
    """The value held between two bounds; null stays null."""
    return F.when(col < low, F.lit(low)).when(col > high, F.lit(high)).otherwise(col)


def cap_scale(col: Column, cap: Column) -> Column:
    """clip(x / cap, 0, 1); zero when the cap is not positive."""
    return F.when(cap > 0, clip(ratio(col, cap), 0.0, 1.0)).otherwise(0.0)


def intensity(a: Column, b: Column, c: Column, weights=(0.4, 0.3, 0.3)) -> Column:
    """Weighted sum of three scaled columns, clipped to [0, 1]."""
    wa, wb, wc = weights
    return clip(a * wa + b * wb + c * wc, 0.0, 1.0)


def rule_score(flag: Column, kilos: Column, both: Column, count: Column) -> Column:
    """3 * flag + 2 * min(kilos, 10) + 2 * both + 0.1 * count."""
    return flag.cast("double") * 3 + F.when(kilos > 10, 10.0).otherwise(kilos) * 2 + both.cast("double") * 2 + count * 0.1


def destandardise(col: Column, mean: Column, sd: Column) -> Column:
    """Back to the scale of counts, at least 0; null stays null."""
    return F.when(col * sd + mean < 0, 0.0).otherwise(col * sd + mean)
