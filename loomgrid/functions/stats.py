"""Scalar formulas of densities and scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the score formulas.
NOTE_ALPHA, NOTE_LAMBDA = 1.65, 0.35
PEAK_FLOOR, PEAK_ALPHA = 10.0, 1.35
RATIO_WEIGHT, DENSITY_WEIGHT, FUSION_EPSILON = 0.65, 0.35, 0.001
HANDTRIP_ALPHA = 1.7
TRICKY_MIDDLE, TRICKY_LEFT, TRICKY_FLAT, TRICKY_RIGHT, NO_TRIPLE_BASE = 84.0, 1.35, 0.20, 1.75, 0.2
SCORES = ("note", "peak", "charge", "slide", "handtrip", "tricky")


def col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def ratio(a, b) -> Column:
    """a / b; 0 where b is 0 or null."""
    a, b = col(a), col(b)
    return F.when(b != 0, a.cast("double") / b).otherwise(0.0)


def per_second(a, seconds) -> Column:
    """a / seconds; 0 unless seconds is positive."""
    a, seconds = col(a), col(seconds)
    return F.when(seconds > 0, a.cast("double") / seconds).otherwise(0.0)


def median_nonzero(v, fallback: float = 0.0) -> Column:
    """The median of the values of a group that are above 0; the fallback without any (an aggregate)."""
    return F.coalesce(F.percentile(F.when(col(v) > 0, col(v)), F.lit(0.5)), F.lit(fallback))


def clip(v, low=0.0, high=1.0) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), col(v)))


def between_percentiles(v, low, high) -> Column:
    """Place of v between two percentiles, clipped; where they are equal, a half if v is positive."""
    v, low, high = col(v), col(low), col(high)
    equal = F.abs(high - low) <= F.greatest(F.abs(low), F.abs(high)) * 1e-9
    return F.when(equal, F.when(v > 0, 0.5).otherwise(0.0)).otherwise(clip((v - low) / F.when(equal, 1.0).otherwise(high - low)))


def share_of(v, high) -> Column:
    """v / high, clipped; 0 unless high is positive."""
    high = col(high)
    return F.when(high > 0, clip(col(v) / high)).otherwise(0.0)


def fused_score(ratio_value, density_value, ratio_98, density_98) -> Column:
    """0 to 200 from a share of notes and their density, each against its 98th percentile."""
    r, d, r98, d98 = map(col, (ratio_value, density_value, ratio_98, density_98))
    some = (r > 0) & (d > 0)
    x = F.when(~some, 0.0).otherwise(F.when(r98 > 0, clip(r / r98)).otherwise(1.0))
    y = F.when(~some, 0.0).otherwise(F.when(d98 > 0, clip(d / d98)).otherwise(1.0))
    fused = (x * y * (1 + FUSION_EPSILON)) / (x * RATIO_WEIGHT + y * DENSITY_WEIGHT + FUSION_EPSILON)
    return clip(F.when(some, fused).otherwise(0.0)) * 200


def burst_score(density, density_98) -> Column:
    return clip(F.pow(share_of(density, density_98), F.lit(PEAK_ALPHA)) * (200.0 - PEAK_FLOOR) + PEAK_FLOOR, 0, 200)


def note_score(mean, cv, mean_95, cv_05, cv_95) -> Column:
    raw = F.pow(share_of(mean, mean_95), F.lit(NOTE_ALPHA)) * ((between_percentiles(cv, cv_05, cv_95) - 0.5) * NOTE_LAMBDA + 1)
    return clip(raw / (1 + NOTE_LAMBDA / 2)) * 200


def handtrip_score(density, density_98) -> Column:
    return clip(F.pow(F.when(col(density) > 0, share_of(density, density_98)).otherwise(0.0), F.lit(HANDTRIP_ALPHA))) * 200


def hermite(t: Column, y0: float, y1: float, slope0: float, slope1: float) -> Column:
    """The cubic with these values and slopes at 0 and 1, by Horner's rule."""
    return ((t * (2 * y0 - 2 * y1 + slope0 + slope1) + (3 * y1 - 3 * y0 - 2 * slope0 - slope1)) * t + slope0) * t + y0


def tricky_curve(base) -> Column:
    """Steep, flat, steep from 0 through TRICKY_MIDDLE at 100 to 200."""
    x, middle = clip(col(base) / 200.0), TRICKY_MIDDLE / 200.0
    left = hermite(x / 0.5, 0.0, middle, TRICKY_LEFT * 0.5, TRICKY_FLAT * 0.5)
    right = hermite((x - 0.5) / 0.5, middle, 1.0, TRICKY_FLAT * 0.5, TRICKY_RIGHT * 0.5)
    return F.when(x <= 0.5, clip(left)).otherwise(clip(right)) * 200


def tricky_score(shortest, intensity_98) -> Column:
    """From the shortest triple of one button: none is almost 0, a time of 0 is the most."""
    s, i98 = col(shortest), col(intensity_98)
    fast = F.when(s > 0, F.when(i98 > 0, clip(1 / F.when(s > 0, s).otherwise(1.0) / F.when(i98 > 0, i98).otherwise(1.0))).otherwise(1.0)).otherwise(1.0)
    return tricky_curve(F.when(s.isNull(), F.lit(NO_TRIPLE_BASE)).otherwise(fast * 200))


def dominant(scores: dict[str, Column]) -> Column:
    """The name of the largest score, the first in order among equals."""
    ranked = F.array(*(F.struct(v.alias("v"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, v) in enumerate(scores.items())))
    return F.array_max(ranked)["k"]


def level_value(level, plus: float) -> Column:
    """`13+` as 13 and `plus`; null if it is no number. Segment labels take a plus of 0.5, tables 0.6."""
    text = F.trim(col(level))
    plain = F.regexp_replace(text, r"\+$", "")
    return plain.try_cast("double") + F.when(text.endswith("+"), F.lit(plus)).otherwise(0.0)


def conditions(level, scores: list) -> Column:
    """Level / 15 (0 to 1.5) and scores / 200 (0 to 2) as one array."""
    return F.array(clip(col(level) / 15.0, 0, 1.5), *(clip(col(s) / 200.0, 0, 2) for s in scores))
