"""Operators on long series (media_id, label, time, y): clamp, rescale, invert, interpolate, combine.

Per-series bounds come from an aggregate that is joined back, not from a window,
so a very long series is still spread over tasks. Whole-series operators need all
rows and refuse streaming input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .positions import numbered
from .skew import dealt

KEYS = ("media_id", "label")


def _bounded(df: DataFrame, what: str) -> None:
    if df.isStreaming:
        raise ValueError(f"{what} needs whole series, so it can't run on a stream")


def _with_bounds(df: DataFrame, keys: Sequence[str], y: str = "y") -> DataFrame:
    bounds = df.groupBy(*keys).agg(F.min(y).alias("_lo"), F.max(y).alias("_hi")).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(bounds, on, "left").drop(*(f"_k_{k}" for k in keys))


def scalar_threshold(df: DataFrame, min: float | None = None, max: float | None = None, compat: bool = False) -> DataFrame:
    """Clamp y to [min, max]; a bound of None is off, with compat also a bound of 0."""
    off = (lambda b: not b) if compat else (lambda b: b is None)
    y = F.col("y")
    if not off(min):
        y = F.when(y < min, F.lit(float(min))).otherwise(y)
    if not off(max):
        y = F.when(y >= max, F.lit(float(max))).otherwise(y)
    return df.withColumn("y", y)


def invert_scalar(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """1 - y; a series that leaves [0, 1] is rescaled to it before, and is null if constant."""
    _bounded(df, "invert_scalar")
    wide = _with_bounds(df, keys)
    lo, hi, y = F.col("_lo"), F.col("_hi"), F.col("y")
    scaled = F.when((hi > 1) | (lo < 0), F.try_divide(y - lo, hi - lo)).otherwise(y)
    return wide.withColumn("y", 1 - scaled).drop("_lo", "_hi")


def min_max_norm(df: DataFrame, eps: float = 0.01, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rescale series whose range is at least eps; others pass."""
    _bounded(df, "min_max_norm")
    lo, hi, y = F.col("_lo"), F.col("_hi"), F.col("y")
    return _with_bounds(df, keys).withColumn("y", F.when(hi - lo >= eps, F.try_divide(y - lo, hi - lo)).otherwise(y)).drop("_lo", "_hi")


def rescale(df: DataFrame, lo: float | None = None, hi: float | None = None, keys: Sequence[str] = KEYS, y: str = "y", normalize: bool = True) -> DataFrame:
    """(y - lo) / (hi - lo), with the series' own bounds unless both are given and not 0; null where they are equal."""
    if not normalize:
        return df
    if lo and hi:
        return df.withColumn(y, F.try_divide(F.col(y) - lo, F.lit(float(hi - lo))))
    _bounded(df, "rescale")
    return _with_bounds(df, keys, y).withColumn(y, F.try_divide(F.col(y) - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def longest_series(df: DataFrame, by: str = "media_id", label: str = "label", order: str | None = None) -> DataFrame:
    """The label of each media's series with the most points; the first in order wins ties."""
    order = order or label
    counts = df.groupBy(by, label).agg(F.count("*").alias("points"), F.min(order).alias("_o"))
    first = Window.partitionBy(by).orderBy(F.desc("points"), "_o")
    return counts.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(by, label, "points")


def interpolate(series: DataFrame, grid: DataFrame, keys: Sequence[str] = KEYS, width: float | None = None) -> DataFrame:
    """Values of each series at the times of `grid` (keys, time): linear inside, the end values outside.

    Knots and grid are merged, one row a time, in partitions of so many counted rows (see skew.dealt), and sorted once
    by series in each direction; no range join. With `width` time is cut
    into buckets, so that one long series is dealt over many tasks: the knots next to a bucket come from a small
    table of each bucket's first and last knot. Knots of equal time count as their mean; a series without knots
    gives nulls.
    """
    _bounded(series, "interpolate")
    knots = series.where("y is not null and time is not null").select(*keys, "time", "y", F.lit(False).alias("_grid"))
    asked = grid.select(*keys, "time", F.lit(None).cast("double").alias("y"), F.lit(True).alias("_grid")).where("time is not null")
    rows, names = knots.unionByName(asked).withColumn("_b", F.floor(F.col("time") / width) if width else F.lit(0)), [*keys, "_b"]
    both = dealt(rows, names, series.count() + grid.count()).groupBy(*names, "time").agg(F.avg("y").alias("y"), F.max("_grid").alias("_grid"))
    knot = F.when(F.col("y").isNotNull(), F.struct("time", "y"))
    so_far = lambda order: Window.partitionBy(*names).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumns({"_before": F.last(knot, ignorenulls=True).over(so_far(F.col("time"))), "_after": F.last(knot, ignorenulls=True).over(so_far(F.col("time").desc()))}).where("_grid")
    a, b = F.col("_before"), F.col("_after")
    if width:
        ends = both.groupBy(*names).agg(F.max_by(knot, F.when(F.col("y").isNotNull(), F.col("time"))).alias("_last"), F.min_by(knot, F.when(F.col("y").isNotNull(), F.col("time"))).alias("_first"))
        others = lambda order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumns({"_low": F.last("_last", ignorenulls=True).over(others(F.col("_b"))), "_high": F.last("_first", ignorenulls=True).over(others(F.col("_b").desc()))})
        ends = ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(names)), "_low", "_high")
        met = met.join(ends, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(names)])
        met = met.withColumns({"_before": F.coalesce("_before", "_low"), "_after": F.coalesce("_after", "_high")})
    inside = a["y"] + F.coalesce(F.try_divide((b["y"] - a["y"]) * (F.col("time") - a["time"]), b["time"] - a["time"]), F.lit(0.0))
    y = F.when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).otherwise(inside)
    return met.select(*keys, "time", y.alias("y"))


def combine(how: str, y: Column) -> Column:
    """mean; prod and and: the product; or: 1 - product(1 - y). Other names mean."""
    if how in ("prod", "and"):
        return F.product(y)
    if how == "or":
        return 1 - F.product(1 - y)
    return F.avg(y)


def aggregate_scalar(df: DataFrame, how: str = "prod", width: float | None = None) -> DataFrame:
    """All series of a media on the times of its longest one, combined by time: (media_id, time, y). width: as for interpolate."""
    longest = longest_series(df).select("media_id", F.col("label").alias("_longest"))
    times = df.join(longest, "media_id").where("label = _longest").select("media_id", "time").distinct()
    labels = df.select("media_id", "label").distinct()
    on_grid = interpolate(df, labels.join(times, "media_id"), width=width)
    return on_grid.groupBy("media_id", "time").agg(combine(how, F.col("y")).alias("y"))


def aggregate_per_time(df: DataFrame, how: str = "or", keys: Sequence[str] = KEYS) -> DataFrame:
    """One value for each series and time."""
    return df.groupBy(*keys, "time").agg(combine(how, F.col("y")).alias("y"))


def append_series(listed: DataFrame, child: DataFrame, label: str | None = None) -> DataFrame:
    """Add a child series (media_id, time, y); without a label its place in the list is its label."""
    n = listed.groupBy("media_id").agg(F.count_distinct("label").alias("_n"))
    name = F.lit(label) if label is not None else F.coalesce(F.col("_n"), F.lit(0)).cast("string")
    named = child.join(n, "media_id", "left").withColumn("label", name).drop("_n")
    return listed.unionByName(named.select(*listed.columns))


def series_index(df: DataFrame, order: str = "label") -> DataFrame:
    """(media_id, idx, label, points): the list of each media in order."""
    counted = df.groupBy("media_id", "label").agg(F.count("*").alias("points"), F.min(order).alias("_o"))
    return numbered(counted, ["media_id"], ["_o", "label"], "idx").withColumn("idx", F.col("idx").cast("int")).drop("_o")
