"""Distances on the ring of eight buttons, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_distance(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(8))
    return F.least(d, F.lit(8) - d).cast("double")


def clockwise_steps(a: Column, b: Column) -> Column:
    return F.pmod(b - a, F.lit(8))


def direction(a: Column, b: Column) -> Column:
    """same, cw, ccw or opposite, whichever way is shorter."""
    cw = clockwise_steps(a, b)
    return F.when(cw == 0, "same").when(cw == 4, "opposite").when(cw < 4, "cw").otherwise("ccw")


def lane_center(lanes: Column) -> Column:
    """Mean of lanes unwrapped at the lane that gives the smallest range, the first among equals; no lanes: 0."""

    def unwrapped(anchor: Column) -> Column:
        return F.transform(lanes, lambda x: F.when(x < anchor, x + 8).otherwise(x))

    def place(anchor: Column, i: Column) -> Column:
        u = unwrapped(anchor)
        return F.struct((F.array_max(u) - F.array_min(u)).alias("range"), i.alias("i"), (F.aggregate(u, F.lit(0.0), lambda s, x: s + x) / F.size(u)).alias("mean"))

    return F.when(F.size(lanes) > 0, F.array_min(F.transform(lanes, place))["mean"]).otherwise(0.0)


def bottleneck(left: Column, right: Column) -> Column:
    """Whether equally many lanes can be paired so that no pair is more than one step apart.

    On a ring such a pairing, if there is one, is a rotation of the sorted lanes, so the rotations are all that must be tried."""
    n = F.size(left)

    def worst(shift: Column) -> Column:
        return F.array_max(F.zip_with(left, F.concat(F.slice(right, shift + 1, n), F.slice(right, F.lit(1), shift)), ring_distance))

    return F.array_min(F.transform(F.sequence(F.lit(0), n - 1), worst))


def moment_distance(left: Column, right: Column) -> Column:
    """Distance of two moments' lanes; see sorted_distance."""
    a, b = F.array_sort(left), F.array_sort(right)
    return sorted_distance(a, b, lane_center(a), lane_center(b))


def sorted_distance(a: Column, b: Column, center_a: Column, center_b: Column) -> Column:
    """Distance of two moments' sorted lanes with their centres: of single lanes on the ring, of one to several the least, of equally many a step of at most one for all, else the plain difference of the centres."""
    one = lambda x, many: F.array_min(F.transform(many, lambda y: ring_distance(F.get(x, F.lit(0)), y)))
    near = F.when(F.size(a) == F.size(b), bottleneck(a, b))
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .when(F.size(a) == 1, one(a, b))
        .when(F.size(b) == 1, one(b, a))
        .otherwise(F.coalesce(F.when(near <= 1, near), F.abs(center_a - center_b)))
    )


def path_distance(path: Column) -> Column:
    """Sum of the ring distances along a path."""
    steps = F.zip_with(F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))), ring_distance)
    return F.when(F.size(path) < 2, F.lit(0.0)).otherwise(F.aggregate(steps, F.lit(0.0), lambda s, x: s + x))
