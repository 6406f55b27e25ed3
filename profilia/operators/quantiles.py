"""Exact quantiles of whole columns, for all columns and quantiles in the same few passes.

A pass counts, for each rank that is still sought, the values between its bounds in BINS bins of equal width, with the least and the
greatest value of each bin. The bin that holds the rank gives its next bounds; a rank is found once they are equal. Values of a bin are
never gathered, and ties only add to a count.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a pass; the driver sees at most so many rows for each rank.
BINS = 1024


def exact_quantiles(df: DataFrame, columns: list[str], qs: list[float]) -> dict[str, list[float | None]]:
    """For each column the quantiles qs (0 to 1) of its values, between ranks linearly interpolated; None for a column without values.

    Nulls and NaN are left out; values are finite. df is read once for the ranges and once for each pass, so it should be a table.
    """
    value = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    first = df.agg(*[f(value(c)).alias(f"{n}{k}") for k, c in enumerate(columns) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    place = lambda k, q: q * (first[f"n{k}"] - 1)
    sought = {(k, r) for k in range(len(columns)) if first[f"n{k}"] for q in qs for r in (math.floor(place(k, q)), math.ceil(place(k, q)))}
    bounds = {(k, r): (first[f"lo{k}"], first[f"hi{k}"], r) for k, r in sought}
    found: dict[tuple[int, int], float] = {}
    while True:
        found |= {t: lo for t, (lo, hi, _) in bounds.items() if lo == hi}
        bounds = {t: b for t, b in bounds.items() if t not in found}
        if not bounds:
            break
        ranges = sorted({(k, lo, hi) for (k, _), (lo, hi, _) in bounds.items()})
        spec = df.sparkSession.createDataFrame([(n, *r) for n, r in enumerate(ranges)], "target int, k int, lo double, hi double")
        open_ = sorted({k for k, _, _ in ranges})
        long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), value(columns[k]).alias("v")) for k in open_])).alias("x")).select("x.k", "x.v")
        inside = long.join(F.broadcast(spec), "k").where("v >= lo and v <= hi")  # a row for each range
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves, as the span may be too wide for a double
        counted = inside.groupBy("target", F.least(F.lit(BINS - 1), F.floor(share * BINS)).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        bins: dict[tuple, list] = {}
        for r in sorted(counted.collect(), key=lambda r: r["bin"]):
            bins.setdefault(ranges[r["target"]], []).append(r)
        for (k, r), (lo, hi, rank) in bounds.items():
            for b in bins[k, lo, hi]:
                if rank < b["n"]:
                    bounds[k, r] = (b["lo"], b["hi"], rank)
                    break
                rank -= b["n"]

    def at(k: int, q: float) -> float | None:
        if not first[f"n{k}"]:
            return None
        p = place(k, q)
        low, high = math.floor(p), math.ceil(p)
        return found[k, low] if low == high else (high - p) * found[k, low] + (p - low) * found[k, high]

    return {c: [at(k, q) for q in qs] for k, c in enumerate(columns)}
