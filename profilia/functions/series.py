"""Window expressions over a series: one row for each present month, in order, for each entity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def interpolated(c: Column, i: Column, w: WindowSpec, back: WindowSpec) -> Column:
    """Missing values linearly between their neighbours by position, the ends filled flat; back is w in descending order.

    Both neighbours come from running frames, so a series costs time in proportion to its length.
    """
    here = F.when(c.isNotNull(), F.struct(i.alias("i"), c.alias("y")))
    seen = lambda x: F.last(here, ignorenulls=True).over(x.rowsBetween(Window.unboundedPreceding, 0))
    p, n = seen(w), seen(back)
    between = p["y"] + (n["y"] - p["y"]) * (i - p["i"]) / (n["i"] - p["i"])
    return F.coalesce(c, F.when(p.isNotNull() & n.isNotNull(), between), p["y"], n["y"])


def winsorized(c: Column, low: float, high: float, whole: WindowSpec) -> Column:
    ends = F.percentile(c, F.array(F.lit(low), F.lit(high))).over(whole)
    return F.when(c.isNotNull(), F.least(F.greatest(c, ends[0]), ends[1]))


def hat_matrix(window: int, poly: int) -> np.ndarray:
    """Row r gives the weights of a least-squares polynomial's value at the r-th point of a window."""
    x = np.vander(np.arange(window) - window // 2, poly + 1, increasing=True).astype(float)
    return x @ np.linalg.pinv(x)


def smoothed(c: Column, i: Column, n: Column, w: WindowSpec, window: int = 5, poly: int = 2) -> Column:
    """Polynomial smoothing with fitted ends; series shorter than the window stay as they are."""
    h, half = hat_matrix(window, poly), window // 2
    shift = {k: (F.lag(c, -k) if k < 0 else F.lead(c, k)).over(w) if k else c for k in range(1 - window, window)}

    def at(r: int) -> Column:
        out = F.lit(float(h[r, 0])) * shift[-r]
        for j in range(1, window):
            out = out + F.lit(float(h[r, j])) * shift[j - r]
        return out

    out = F.when(n < window, c)
    for r in range(half):
        out = out.when(i == r, at(r)).when(i == n - 1 - r, at(window - 1 - r))
    return out.otherwise(at(half))


def mean_slope(y: Column, t: Column, w: WindowSpec, win: int) -> Column:
    """Slope in the frame that starts at a row, where the frame is whole and has enough values; average it for the mean."""
    f = w.rowsBetween(0, win - 1)
    return F.when((F.count(F.lit(1)).over(f) == win) & (F.count(y).over(f) >= max(2, win // 2)), F.regr_slope(y, t.cast("double")).over(f))


def rolling_std(y: Column, w: WindowSpec, win: int) -> Column:
    f = w.rowsBetween(0, win - 1)
    return F.when((F.count(F.lit(1)).over(f) == win) & (F.count(y).over(f) >= max(2, win // 2)), F.stddev_pop(y).over(f))
