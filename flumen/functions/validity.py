"""Which samples count, and guarded arithmetic. Invalid values are NULL inside the engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("nan", "zero", "zero-or-nan", "none")


def clamped(current: Column, offset: Column, upper: Column) -> Column:
    """An index moved by an offset, within 0 and upper."""
    return F.least(F.greatest(current + offset, F.lit(0)), upper)


def quantity(name: str) -> Column:
    """A mean product's quantity by its name: speed (of the mean) or a component."""
    names = {"speed": "speed_from_mean", "u": "u_mean", "v": "v_mean", "w": "w_mean"}
    if name not in names:
        raise ValueError(f"a quantity is one of {tuple(names)}")
    return F.col(names[name])


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def component_valid(c: Column, mode: str = "nan") -> Column:
    """zero: other than 0 (a NaN counts as valid); nan: finite; zero-or-nan: both; none: any value."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}, not {mode!r}")
    some = c.isNotNull()
    return {"zero": some & (c != 0), "nan": finite(c), "zero-or-nan": finite(c) & (c != 0), "none": some}[mode]


def vector_valid(components: list[Column], mode: str = "nan") -> Column:
    """zero: any component other than 0; nan: all finite; zero-or-nan: all finite and any other than 0; none: all there."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}, not {mode!r}")
    every, some, nonzero = F.lit(True), F.lit(True), F.lit(False)
    for c in components:
        every, some, nonzero = every & finite(c), some & c.isNotNull(), nonzero | (c != 0)
    return {"zero": some & nonzero, "nan": every, "zero-or-nan": every & nonzero, "none": some}[mode]


def valid_flags(mode: str = "nan", mask: str = "component", names: tuple[str, ...] = ("u", "v", "w")) -> dict[str, Column]:
    """The validity of each component, its own (mask component) or that of the whole vector (mask vector)."""
    if mask not in ("component", "vector"):
        raise ValueError(f"mask is component or vector, not {mask!r}")
    if mask == "vector":
        v = vector_valid([F.col(n) for n in names], mode)
        return {n: v for n in names}
    return {n: component_valid(F.col(n), mode) for n in names}


def enough(count: Column, n: Column, fraction: float) -> Column:
    """At least one, and at least the fraction's part of n, rounded up."""
    return (count > 0) & (count >= F.ceil(F.lit(float(fraction)) * n))


def speed(u: Column, v: Column, w: Column | None = None) -> Column:
    return F.sqrt(u * u + v * v + (w * w if w is not None else F.lit(0.0)))


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def bin_of(phase: Column, n: int) -> Column:
    """The phase's bin of n over a turn; a phase of a whole turn falls into the last one."""
    return F.least(F.floor(phase / (2 * math.pi / n)), F.lit(n - 1)).cast("int")


def phase_of(t: Column, frequency: float, offset: float = 0.0) -> Column:
    return F.pmod(2 * math.pi * frequency * t + offset, F.lit(2 * math.pi))


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
