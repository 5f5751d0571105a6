"""Slide geometry on the ring of buttons: sampled paths, lengths and how alike shapes are.

There are few slide segments (shape, start, middle, end), so paths are computed once each and looked
up after that.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: All shapes, those that are compared softly, control offsets and samples of a path, scale of likeness.
SHAPES = ("-", ">", "<", "^", "v", "p", "q", "s", "z", "pp", "qq", "V", "w")
SOFT_SHAPES = SHAPES[:11]
BEND = {"p": 0.55, "q": -0.55, "pp": 1.05, "qq": -1.05}
WAVE = {"s": 0.70, "z": -0.70}
SAMPLES, SOFTNESS = 16, 0.42
#: The shape a mirror makes of a shape; others stay.
MIRRORED = {">": "<", "<": ">", "p": "q", "q": "p", "pp": "qq", "qq": "pp", "s": "z", "z": "s"}


def ring_steps(a: int, b: int) -> int:
    d = (b - a) % 8
    return min(d, 8 - d)


def direction(a: int, b: int) -> str:
    cw = (b - a) % 8
    return "same" if cw == 0 else "opposite" if cw == 4 else "cw" if cw < 4 else "ccw"


def on_ring(index) -> np.ndarray:
    """Points of the unit circle; index 0 is at the top, clockwise."""
    angle = np.pi / 2 - np.pi * np.asarray(index, float) / 4
    return np.stack([np.cos(angle), np.sin(angle)], -1)


def along(corners: np.ndarray) -> np.ndarray:
    """Points at equal distances along a line through corners."""
    steps = np.sqrt((np.diff(corners, axis=0) ** 2).sum(1))
    at = np.concatenate([[0.0], np.cumsum(steps)])
    if at[-1] <= 0:
        return np.repeat(corners[:1], SAMPLES, 0)
    t = np.linspace(0, at[-1], SAMPLES)
    return np.stack([np.interp(t, at, corners[:, k]) for k in (0, 1)], -1)


def beside(start: int, end: int, offset: float) -> np.ndarray:
    """The middle of the chord, moved to its left by an offset."""
    a, b = on_ring(start - 1), on_ring(end - 1)
    chord = b - a
    size = np.hypot(*chord) or 1.0
    return (a + b) / 2 + np.array([-chord[1], chord[0]]) / size * offset


@lru_cache(maxsize=None)
def path(shape: str, start: int, middle: int, end: int) -> np.ndarray:
    """The sampled path of a segment; middle is 0 for all shapes but V."""
    a, b = on_ring(start - 1), on_ring(end - 1)
    t = np.linspace(0, 1, SAMPLES)
    cw = (end - start) % 8
    if shape == "^":
        shape = ">" if cw <= (-cw) % 8 else "<"
    if shape == ">":
        return on_ring(start - 1 + (cw or 8) * t)
    if shape == "<":
        return on_ring(start - 1 - ((-cw) % 8 or 8) * t)
    if shape in BEND:
        control, u = beside(start, end, BEND[shape]), t[:, None]
        return (1 - u) ** 2 * a + 2 * u * (1 - u) * control + u**2 * b
    if shape in WAVE:
        return along(np.stack([a, beside(start, end, WAVE[shape]), beside(start, end, -WAVE[shape]), b]))
    if shape == "v":
        return along(np.stack([a, np.zeros(2), b]))
    if shape == "V":
        return along(np.stack([a, on_ring((middle or end) - 1), b]))
    if shape == "w":
        return np.mean([along(np.stack([a, on_ring(end - 1 + k)])) for k in (-1, 0, 1)], axis=0)
    return along(np.stack([a, b]))


def apart(a: np.ndarray, b: np.ndarray) -> float:
    """Mean distance of two paths' samples."""
    return float(np.sqrt(((a - b) ** 2).sum(1)).mean())


@lru_cache(maxsize=None)
def length(shape: str, start: int, middle: int, end: int) -> float:
    return float(np.sqrt((np.diff(path(shape, start, middle, end), axis=0) ** 2).sum(1)).sum())


@lru_cache(maxsize=None)
def soft_shapes(shape: str, start: int, middle: int, end: int) -> tuple[float, ...]:
    """How much a segment is like each soft shape between its ends."""
    own = path(shape, start, middle, end)
    return tuple(float(np.exp(-apart(own, path(s, start, 0, end)) / SOFTNESS)) for s in SOFT_SHAPES)


def segment_distance(a: tuple[str, int, int, int], b: tuple[str, int, int, int]) -> float:
    """Distance of segments: of their paths, and parts for ends, middles and shapes."""
    ends = (ring_steps(a[1], b[1]) + ring_steps(a[3], b[3])) / 8
    middle = 0.0 if not a[2] and not b[2] else 1.0 if not a[2] or not b[2] else ring_steps(a[2], b[2]) / 4
    return apart(path(*a), path(*b)) + 0.25 * ends + 0.10 * middle + (0.0 if a[0] == b[0] else 0.25)


def turned(lane: int, rotation: int, mirror: bool) -> int:
    """A lane under one of the sixteen symmetries of the ring; 0 stays 0."""
    if not lane:
        return lane
    return (((1 - lane) if mirror else lane - 1) + rotation) % 8 + 1


def table():
    """Every segment with its length and likenesses, for a lookup join: (shape, start, middle, end, length, soft)."""
    for shape in SHAPES:
        for start in range(1, 9):
            for end in range(1, 9):
                for middle in range(1, 9) if shape == "V" else (0,):
                    yield shape, start, middle, end, length(shape, start, middle, end), list(soft_shapes(shape, start, middle, end))
