"""Report data, CSV summaries, SVG charts and an HTML page from small aggregated frames."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.anomaly import top_anomalies
from .operators.clusters import cluster_prototypes, mean_bands
from .operators.lineage import cut
from .operators.quantiles import exact_quantiles

#: Rows of a table in the page, points of a chart, lines of a chart.
TABLE_ROWS, POINTS, LINES = 50, 5000, 100


def map_data(map_: DataFrame, share: float = 0.05, medoids: DataFrame | None = None) -> DataFrame:
    """(well_name, x, y, cluster, anomaly_score) with `anomalous`, the top share by score, and `medoid`: whether it is in medoids (well_name)."""
    map_ = cut(map_)
    bound = exact_quantiles(map_, ["anomaly_score"], [1 - share])["anomaly_score"][0]
    named = F.lit(False)
    if medoids is not None:
        map_, named = map_.join(medoids.select("well_name", F.lit(True).alias("__medoid")), "well_name", "left"), F.coalesce("__medoid", F.lit(False))
    return map_.select("well_name", "x", "y", "cluster", (F.col("anomaly_score") >= F.lit(bound).cast("double")).alias("anomalous"), named.alias("medoid"))


def prototype_lines(panel: DataFrame, labels: DataFrame, channel: str, T: int = 36) -> DataFrame:
    """name (of the cluster), t, y, low, high: each cluster's median with its quartiles."""
    found = cluster_prototypes(panel, labels, [channel], T)
    return found.select(F.concat(F.lit("cluster "), F.col("cluster").cast("string")).alias("name"), "t", F.col("value").alias("y"), F.col("p25").alias("low"), F.col("p75").alias("high"))


def mean_lines(panel: DataFrame, labels: DataFrame, channel: str, T: int = 36) -> DataFrame:
    """name (of the cluster), t, y, low, high: each cluster's mean between its 10th and 90th percentile."""
    found = mean_bands(panel, labels, channel, T)
    return found.select(F.concat(F.lit("cluster "), F.col("cluster").cast("string")).alias("name"), "t", F.col("mean").alias("y"), F.col("p10").alias("low"), F.col("p90").alias("high"))


def forecast_lines(long: DataFrame, predictions: dict[str, str], wells: int = 6) -> DataFrame:
    """(well_name, t, y_true, a column for each prediction) -> name, t, y of the first wells by name: the truth and what each method says.

    predictions: names of the methods and of their columns.
    """
    some = long.select("well_name").distinct().orderBy("well_name").limit(wells)
    columns = {"truth": "y_true"} | predictions
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.col(c).cast("double").alias("y")) for n, c in columns.items()])).alias("x")
    rows = long.join(F.broadcast(some), "well_name").select("well_name", "t", each)  # a few names
    return rows.select(F.concat_ws(" ", "well_name", "x.method").alias("name"), "t", "x.y").where("y is not null")


def cluster_sizes(map_: DataFrame) -> DataFrame:
    return map_.groupBy("cluster").agg(F.count("*").alias("size")).orderBy("cluster")


def export_csv_summaries(map_: DataFrame, summary: DataFrame, out: str, k: int = 50) -> None:
    """map, cluster summary and top anomalies as CSV folders under out."""
    for name, df in (("map", map_), ("cluster_summary", summary.orderBy("cluster")), ("top_anomalies", top_anomalies(map_.withColumnRenamed("well_name", "id"), k))):
        df.write.mode("overwrite").option("header", True).csv(f"{out}/{name}")


def export_forecasts(long: dict[str, DataFrame], metrics: dict[str, DataFrame], out: str) -> None:
    """pred_<model> (a column for each month) and metrics (a row for each model) as CSV folders under out."""
    for name, df in long.items():
        wide = df.where("segment = 'forecast'").groupBy("well_name").pivot("t").agg(F.max("y_pred"))
        wide.select("well_name", *[F.col(f"`{c}`").alias(f"m{int(c) + 1}") for c in sorted(wide.columns[1:], key=int)]).write.mode("overwrite").option("header", True).csv(f"{out}/pred_{name}")
    rows = None
    for name, df in metrics.items():
        one = df.select(F.lit(name).alias("model"), "rmse", "smape", "n_eval")
        rows = one if rows is None else rows.unionByName(one)
    if rows is not None:
        rows.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/metrics")


def export_matrix(rows: DataFrame, column: str, path: str) -> None:
    """well_name and an array of a matrix's row as Parquet, in the order of names within each file."""
    rows.select("well_name", F.col(column).cast("array<double>").alias("row")).sortWithinPartitions("well_name").write.mode("overwrite").parquet(path)


def lines_svg(rows: DataFrame, width: int = 640, height: int = 240) -> str:
    """(name, t, y[, low, high]) as one line for each name with its band: prototypes, forecasts, cluster means.

    A chart holds the first LINES names, each with all its points, and says how many there are if there are more.
    """
    names = rows.select("name").distinct()
    n = names.count()
    shown = rows if n <= LINES else rows.join(F.broadcast(names.orderBy("name").limit(LINES)), "name")
    found = shown.orderBy("name", "t").collect()
    band = {"low", "high"} <= set(rows.columns)
    ys = [r[c] for r in found for c in (["y", "low", "high"] if band else ["y"]) if r[c] is not None]
    if not ys:
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"/>'
    last, lo, hi = max(r["t"] for r in found) or 1, min(ys), max(ys)
    xy = lambda t, y: f"{10 + t / last * (width - 20):.1f},{height - 10 - (y - lo) / ((hi - lo) or 1) * (height - 20):.1f}"
    out = []
    for k, name in enumerate(sorted({r["name"] for r in found})):
        of = [r for r in found if r["name"] == name and r["y"] is not None]
        hue = f"hsl({k * 67 % 360},65%,45%)"
        if band:
            edge = [xy(r["t"], r["low"]) for r in of] + [xy(r["t"], r["high"]) for r in reversed(of)]
            out.append(f'<polygon points="{" ".join(edge)}" fill="{hue}" fill-opacity="0.2"/>')
        out.append(f'<polyline points="{" ".join(xy(r["t"], r["y"]) for r in of)}" fill="none" stroke="{hue}"><title>{escape(str(name))}</title></polyline>')
    if n > LINES:
        out.append(f'<text x="12" y="14" font-size="11">{LINES} of {n} lines</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{"".join(out)}</svg>'


def scatter_svg(data: DataFrame, width: int = 640, height: int = 480) -> str:
    """The map as SVG; of more than POINTS points those that come first in hash order, with their number. Medoids carry their cluster's number."""
    n = data.count()
    rows = data.orderBy(F.xxhash64("well_name")).limit(POINTS).collect()
    if not rows:
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"/>'
    xs, ys = [r["x"] for r in rows], [r["y"] for r in rows]
    at = lambda v, lo, hi, n: 10 + (v - lo) / ((hi - lo) or 1) * (n - 20)
    hue = lambda c: "#999" if c < 0 else f"hsl({c * 67 % 360},65%,45%)"
    dots = "".join(
        f'<circle cx="{at(r["x"], min(xs), max(xs), width):.1f}" cy="{height - at(r["y"], min(ys), max(ys), height):.1f}" r="3" fill="{hue(r["cluster"])}"' + (' stroke="#000"' if r["anomalous"] else "") + f"><title>{escape(r['well_name'])}</title></circle>" for r in rows
    )
    if "medoid" in data.columns:  # one of each cluster, whether or not its point is among those drawn
        for r in data.where("medoid").limit(POINTS).collect():
            dots += f'<text x="{at(r["x"], min(xs), max(xs), width) + 5:.1f}" y="{height - at(r["y"], min(ys), max(ys), height) - 5:.1f}" font-size="12">{r["cluster"]}</text>'
    note = f'<text x="12" y="14" font-size="11">{POINTS} of {n} points</text>' if n > POINTS else ""
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{dots}{note}</svg>'


def bars_svg(sizes: DataFrame, width: int = 480, height: int = 240) -> str:
    rows = sizes.orderBy("cluster").limit(POINTS).collect()
    top = max((r["size"] for r in rows), default=1)
    step = width / max(1, len(rows))
    bars = "".join(f'<rect x="{k * step + 2:.1f}" y="{height - 20 - r["size"] / top * (height - 40):.1f}" width="{step - 4:.1f}" height="{r["size"] / top * (height - 40):.1f}"/><text x="{k * step + 2:.1f}" y="{height - 4}" font-size="11">{r["cluster"]}</text>' for k, r in enumerate(rows))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{bars}</svg>'


def table_html(df: DataFrame, rows: int = TABLE_ROWS) -> str:
    cells = lambda xs, tag: "".join(f"<{tag}>{escape('' if x is None else str(x))}</{tag}>" for x in xs)
    body = "".join(f"<tr>{cells(r, 'td')}</tr>" for r in df.limit(rows).collect())
    return f"<table><tr>{cells(df.columns, 'th')}</tr>{body}</table>"


def html_report(title: str, sections: list[tuple[str, str]]) -> str:
    """A page of headed sections whose contents are SVG or table markup made above."""
    parts = "".join(f"<h2>{escape(h)}</h2>{body}" for h, body in sections)
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{parts}</body></html>'
