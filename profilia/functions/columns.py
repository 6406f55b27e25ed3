"""Column expressions: dates, rates, ratios, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def month_start(date: Column) -> Column:
    return F.trunc(date, "MM")


def month_end(date: Column) -> Column:
    return F.last_day(date)


def nominal_days(month: Column, mode: str = "reference") -> Column:
    if mode == "calendar":
        return F.dayofmonth(F.last_day(month)).cast("double")
    return F.datediff(F.last_day(month), F.add_months(month, -1)).cast("double")


def rate(volume: Column, days: Column, eps: float = 1e-9) -> Column:
    return F.when(days > 0, volume / (days + F.lit(eps)))


def water_cut(oil: Column, water: Column, eps: float = 1e-9) -> Column:
    return water / (oil + water + F.lit(eps))


def gas_oil_ratio(oil: Column, gas: Column, eps: float = 1e-9) -> Column:
    return gas / (oil + F.lit(eps))


def nonnegative(c: Column) -> Column:
    return F.when(c >= 0, c)


def clipped_ratio(c: Column, scale: Column, eps: float, top: float) -> Column:
    return F.when(c.isNotNull() & scale.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(top), c / (F.abs(scale) + F.lit(eps)))))


def rounded(c: Column, digits: int = 6) -> Column:
    """For comparing results: `digits` places, none for values of a million and more; no negative zero."""
    return F.when(F.abs(c) < 1e6, F.round(c, digits)).otherwise(F.round(c, 0)) + F.lit(0.0)


def slugify(c: Column) -> Column:
    """Characters that file names can't hold, white space and commas become single underscores."""
    x = F.regexp_replace(F.trim(c), r'[\\/:*?"<>|]+', "_")
    x = F.regexp_replace(x, r"[\s,]+", "_")
    return F.regexp_replace(F.regexp_replace(x, "_+", "_"), "^_+|_+$", "")


def sanitize_filename(c: Column) -> Column:
    """Forbidden characters become blanks, blanks are collapsed; nothing left gives 'file'."""
    x = F.trim(F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|]+', " "), r"\s+", " "))
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("file"))


def record_count(label: Column, default: int = 300) -> Column:
    """How many records a label such as 'Records 1 to 300' announces."""
    a, b = (F.regexp_extract(label, r"(?i)Records?\s+(\d+)\s+to\s+(\d+)", i) for i in (1, 2))
    return F.when(a != "", F.greatest(F.lit(1).cast("long"), F.try_subtract(b.cast("long"), a.cast("long")) + 1)).otherwise(F.lit(default).cast("long"))


def group_dir_name(label: Column) -> Column:
    """'records a - b' for a label that names a range, else the sanitized label in lower case."""
    a, b = (F.regexp_extract(label, r"(?i)Records?\s+(\d+)\s+to\s+(\d+)", i) for i in (1, 2))
    return F.when(a != "", F.concat(F.lit("records "), a, F.lit(" - "), b)).otherwise(F.lower(sanitize_filename(F.coalesce(label, F.lit("")))))


def group_index(link: Column) -> Column:
    """The number of the group that a tree link names (s0, two backslashes, digits); null where there is none."""
    return F.nullif(F.regexp_extract(link, r"s0\\\\(\d+)", 1), F.lit("")).cast("long")


def well_file_name(label: Column, suffix: str = ".csv") -> Column:
    return F.concat(sanitize_filename(F.coalesce(label, F.lit(""))), F.lit(suffix))


#: The metadata that name a well's file, in order.
FILE_KEYS = ("Well_Nm", "Well_Type", "Wl_Status", "County", "Field")


def metadata_file_name(metadata: Column) -> Column:
    """Slugs of a metadata map's FILE_KEYS, joined by underscores; "unknown" where a key is absent or null."""
    return F.concat_ws("_", *[slugify(F.coalesce(F.try_element_at(metadata, F.lit(k)), F.lit("unknown"))) for k in FILE_KEYS])


def flatten_channels(*channels: str | Column) -> Column:
    """One vector of all channels' arrays, one after the other; missing and non-finite values count as 0."""
    whole = lambda x: F.when(F.abs(x) < float("inf"), x.cast("double")).otherwise(0.0)
    return F.concat(*[F.transform(c, whole) for c in channels])


def is_tree_node(label: Column) -> Column:
    return label.rlike(r"^\s*\d{6,}\s*-\s*.+")


def trim_trailing_empty(cells: Column) -> Column:
    """The cells up to the last that isn't blank."""
    last = F.aggregate(F.transform(cells, lambda x, i: F.when(F.trim(F.coalesce(x, F.lit(""))) != "", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.slice(cells, F.lit(1), last)
