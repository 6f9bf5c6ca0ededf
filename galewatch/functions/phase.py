"""Specific differential phase: half the slope of differential phase along a ray, by least squares over a window of gates.

Sums over a window are differences of prefix sums along the ray, so a ray costs the same whatever the window's width.
Rays of a batch are one matrix, and sums start anew with every ray, which keeps their rounding small.

Defined cases: a missing gate (null or NaN) is left out of every window; a window is cut at the ray's ends; one of fewer
than `least` gates with a value has no slope (null); a null ray stays null; a spacing that isn't above 0 gives nulls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Gates on each side of a window's middle, and gates with a value that it needs.
HALF, LEAST = 12, 5


def window_slopes(values: np.ndarray, half: int, least: int) -> np.ndarray:
    """Rays by gates, NaN where missing -> the slope per gate around each one."""
    rays, n = values.shape
    known = ~np.isnan(values)
    count = known.sum(axis=1, keepdims=True)
    middle = np.where(known, values, 0.0).sum(axis=1, keepdims=True) / np.maximum(count, 1)
    y, x = np.where(known, values - middle, 0.0), np.arange(n, dtype=np.float64)
    low, high = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)

    def summed(terms: np.ndarray) -> np.ndarray:
        upto = np.concatenate([np.zeros((rays, 1)), np.cumsum(terms, axis=1)], axis=1)
        return upto[:, high] - upto[:, low]

    m, sx, sxx, sy, sxy = summed(known.astype(float)), summed(known * x), summed(known * x * x), summed(y), summed(y * x)
    spread = m * sxx - sx * sx  # whole numbers, exact
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (m * sxy - sx * sy) / spread
    return np.where((m >= max(least, 2)) & (spread > 0), slope, np.nan)


def specific(rays: list, spacing_km: list, half: int = HALF, least: int = LEAST) -> list:
    """Phase in degrees by gate, for rays with their gate spacings -> degrees per km by gate (None for missing)."""
    out: list = [None] * len(rays)
    own = [i for i, r in enumerate(rays) if r is not None]
    longest = max((len(rays[i]) for i in own), default=0)
    if longest == 0:
        return [None if r is None else [] for r in rays]
    values = np.full((len(own), longest), np.nan)
    for k, i in enumerate(own):
        values[k, : len(rays[i])] = np.array([np.nan if v is None else v for v in rays[i]], dtype=np.float64)
    steps = np.array([np.nan if s is None or not s > 0 else s for s in (spacing_km[i] for i in own)], dtype=np.float64)
    found = window_slopes(values, half, least) / 2.0 / steps[:, None]
    for k, i in enumerate(own):
        out[i] = [None if np.isnan(v) else float(v) for v in found[k, : len(rays[i])]]
    return out


def specific_phase(phase: Column, spacing_km: Column, half: int = HALF, least: int = LEAST) -> Column:
    """The same as a column of arrays."""

    @pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rays, spacing in batches:
            for_each = lambda a: specific(rays.iloc[a : a + 256].tolist(), spacing.iloc[a : a + 256].tolist(), half, least)
            yield pd.Series([x for a in range(0, len(rays), 256) for x in for_each(a)], dtype=object)

    return run(phase.cast("array<double>"), spacing_km.cast("double"))


def gate_spacing_km(range_m, default_m: float = 250.0) -> float:
    """The median step of a volume's gate ranges."""
    steps = np.diff(np.asarray([] if range_m is None else range_m, dtype=np.float64))
    steps = steps[np.isfinite(steps)]
    return (float(np.median(steps)) if len(steps) and np.median(steps) > 0 else default_m) / 1000.0


def filled(rays: pd.DataFrame) -> pd.DataFrame:
    """A decoded volume whose specific differential phase is missing, with that derived from its differential phase."""
    source, target = "differential_phase", "specific_differential_phase"
    if source not in rays or (target in rays and rays[target].notna().any()):
        return rays
    heads = rays["range_m"].dropna() if "range_m" in rays else []
    spacing = gate_spacing_km(heads.iloc[0] if len(heads) else None)
    own = [None if r is None or (np.isscalar(r) and pd.isna(r)) else r for r in rays[source]]
    return rays.assign(**{target: pd.Series(specific(own, [spacing] * len(own)), index=rays.index, dtype=object)})
