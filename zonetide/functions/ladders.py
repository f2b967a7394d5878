"""Step thresholds: value -> class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ladders in use, highest step first.
ALERT_STEPS = [(0.8, "CRITICO"), (0.5, "ALTO"), (0.2, "MEDIO")]
ALERT_DEFAULT = "BAIXO"
REGION_FACTOR = {"INTERIOR": 30.0, "RMF": 6.0}
REGION_FACTOR_DEFAULT = 3.0
SHARE_STEPS = [(80.0, "CRITICO"), (60.0, "ALTO"), (40.0, "MEDIO")]
SCORE_STEPS = [(75.0, "CRITICO"), (50.0, "ALTO"), (25.0, "MEDIO")]
VOLATILITY_STEPS = [(0.5, 0.7, "CRITICO"), (0.3, 0.4, "ALTO"), (0.1, 0.2, "MEDIO")]


def ladder(col: Column, steps: Sequence[tuple[float, str]], default: str, inclusive: bool = False) -> Column:
    """First step the value is above (or reaches, when ``inclusive``)."""
    result = None
    for bound, label in steps:
        test = col >= bound if inclusive else col > bound
        result = F.when(test, label) if result is None else result.when(test, label)
    return result.otherwise(default)


def regional_alert(score: Column, region: Column) -> Column:
    """The alert ladder on a score scaled by its region's factor."""
    factor = None
    for name, value in REGION_FACTOR.items():
        factor = F.when(region == name, value) if factor is None else factor.when(region == name, value)
    return ladder(score * factor.otherwise(REGION_FACTOR_DEFAULT), ALERT_STEPS, ALERT_DEFAULT)


def two_column_ladder(first: Column, second: Column, steps=VOLATILITY_STEPS, default: str = ALERT_DEFAULT) -> Column:
    """A step applies when either column is above its own bound."""
    result = None
    for a, b, label in steps:
        test = (first > a) | (second > b)
        result = F.when(test, label) if result is None else result.when(test, label)
    return result.otherwise(default)


def cut(col: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins; null outside the edges."""
    result = None
    for low, high, label in zip(edges[:-1], edges[1:], labels, strict=True):
        test = (col > low) & (col <= high)
        result = F.when(test, label) if result is None else result.when(test, label)
    return result
