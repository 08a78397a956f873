"""Shots: segmentation, annotation from series, density, text and face labels.

Where times are joined, `width` cuts time into buckets (see timejoin.range_join), so
that one long media is dealt over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import rescale
from .timejoin import range_join


def shots_from_scores(series: DataFrame, threshold: float = 0.5, fps: float | None = None, width: int | None = None) -> DataFrame:
    """(media_id, shot_idx, start_s, end_s) from per-frame scores (media_id, i, y).

    A maximal run of frames with y <= threshold is a shot, from its first frame to
    the frame after it (the last frame, if none follows); a media without such a
    run is one shot, from its first to its last frame. Times are frames / fps. With
    `width` frames are cut into buckets of so many, and a bucket gets the cuts before
    it and the frame after it from a table of one row a bucket.
    """
    flagged = series.select("media_id", "i", (F.col("y") > threshold).cast("int").alias("cut")).withColumn("_b", F.floor(F.col("i") / width) if width else F.lit(0))
    w = Window.partitionBy("media_id", "_b").orderBy("i")
    runs = flagged.withColumns({"run": F.sum("cut").over(w), "next": F.lead("i").over(w)})
    if width:
        order = Window.partitionBy("media_id").orderBy("_b")
        ends = flagged.groupBy("media_id", "_b").agg(F.sum("cut").alias("_cuts"), F.min("i").alias("_first"))
        ends = ends.select(F.col("media_id").alias("_m"), F.col("_b").alias("_at"), F.coalesce(F.sum("_cuts").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_first").over(order).alias("_next"))
        met = runs.join(ends, F.col("media_id").eqNullSafe(F.col("_m")) & (F.col("_b") == F.col("_at")))
        runs = met.withColumns({"run": F.coalesce("run", F.lit(0)) + F.col("_before"), "next": F.coalesce("next", "_next")})
    shots = runs.where("cut = 0").groupBy("media_id", "run").agg(F.min("i").alias("first"), F.max(F.coalesce("next", "i")).alias("last"))
    bounds = flagged.groupBy("media_id").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.min("cut").alias("all_cut")).where("all_cut = 1")
    every = shots.select("media_id", "first", "last").unionByName(bounds.select("media_id", "first", "last"))
    scale = F.lit(1.0 / fps) if fps else F.lit(1.0)
    return every.select("media_id", (F.row_number().over(Window.partitionBy("media_id").orderBy("first")) - 1).alias("shot_idx"), (F.col("first") * scale).alias("start_s"), (F.col("last") * scale).alias("end_s"))


def shot_annotator(shots: DataFrame, probs: DataFrame, threshold: float = 0.0, width: float | None = None) -> DataFrame:
    """The label with the highest mean in each shot, (start_s, end_s) open.

    Means that are null, 0 or not above the threshold don't count; the smallest
    label_idx wins ties; shots without a label are left out.
    """
    met = range_join(shots, probs.select("media_id", "label", "label_idx", "time", "y"), "()", width=width)
    means = met.groupBy("media_id", "shot_idx", "start_s", "end_s", "label", "label_idx").agg(F.avg("y").alias("mean")).where((F.col("mean") > threshold) & (F.col("mean") != 0))
    best = means.groupBy("media_id", "shot_idx", "start_s", "end_s").agg(F.max_by(F.struct("label", "mean"), F.struct("mean", -F.col("label_idx"))).alias("b"))
    return best.select("media_id", "shot_idx", "start_s", "end_s", "b.label", "b.mean")


def shot_scalar_annotator(shots: DataFrame, series: DataFrame, width: float | None = None) -> DataFrame:
    """The mean of a series in each shot, [start_s, end_s]; shots without samples are left out."""
    met = range_join(shots, series.select("media_id", "time", "y"), "[]", width=width)
    return met.groupBy("media_id", "shot_idx", "start_s", "end_s").agg(F.avg("y").alias("mean")).withColumn("label", F.col("mean").cast("string"))


def shot_texts(shots: DataFrame, texts: DataFrame, width: float | None = None) -> DataFrame:
    """The texts of each shot in time order, [start_s, end_s]; shots without texts have an empty list."""
    met = range_join(shots, texts.select("media_id", "time", "text"), "[]", "left", width)
    item = F.when(F.col("time").isNotNull(), F.struct("time", "text"))
    return met.groupBy("media_id", "shot_idx", "start_s", "end_s").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["text"]).alias("texts"))


def facesize(boxes: DataFrame, reduction: str = "max") -> DataFrame:
    """(media_id, time, y): the largest, or the mean, area of the boxes of a time."""
    area = F.col("w") * F.col("h")
    return boxes.groupBy("media_id", "time").agg((F.max(area) if reduction == "max" else F.avg(area)).alias("y"))


def face_shot_labels(shots: DataFrame, labels: DataFrame, boxes: DataFrame, width: float | None = None) -> DataFrame:
    """Each shot with its label if a face's time lies in [start_s, end_s), else "None". labels: (media_id, shot_idx, label)."""
    seen = range_join(shots, boxes.select("media_id", "time").distinct(), "[)", width=width).select("media_id", "shot_idx").distinct().withColumn("_seen", F.lit(True))
    joined = shots.join(labels.select("media_id", "shot_idx", "label"), ["media_id", "shot_idx"], "left").join(seen, ["media_id", "shot_idx"], "left")
    return joined.withColumn("label", F.coalesce(F.when(F.col("_seen"), F.col("label")), F.lit("None"))).drop("_seen")


#: Kernels by u = |t - s| / h, without constants, which the rescale cancels; all but the first end at u = 1. The exponential one is exp(-u).
KERNELS = {
    "gaussian": lambda u: F.exp(-0.5 * u * u),
    "tophat": lambda u: F.when(u < 1, 1.0).otherwise(0.0),
    "epanechnikov": lambda u: F.when(u < 1, 1 - u * u).otherwise(0.0),
    "linear": lambda u: F.when(u < 1, 1 - u).otherwise(0.0),
    "cosine": lambda u: F.when(u < 1, F.cos(u * 3.141592653589793 / 2)).otherwise(0.0),
}


def _far(bandwidth: float, fps: float, nines: float) -> float:
    """Bandwidths beyond which a start counts for nothing: less than 1e-17 of the largest value that the nearest point of its grid has."""
    return min(39.0, math.hypot(nines, 0.5 / (fps * bandwidth)))


def shot_density(shots: DataFrame, kernel: str = "gaussian", bandwidth: float = 30.0, fps: float = 10.0) -> DataFrame:
    """(media_id, time, y): kernel density of shot starts on ceil(last end * fps) + 1 even points, rescaled to 0..1.

    A kernel that ends meets the points in its reach. The gaussian one is cut where a start counts less than 1e-17 of
    the largest value (at nine bandwidths, or more if the grid is coarse), which is below the rounding of a sum. The
    exponential one is summed in both directions (see _two_sided). All are linear in the length of a media.
    """
    last = shots.groupBy("media_id").agg(F.max("end_s").alias("_end")).withColumn("_n", F.ceil(F.col("_end") * fps))
    grid = last.select("media_id", F.explode(F.sequence(F.lit(0), F.col("_n"))).alias("_i"), "_end", "_n").select("media_id", "_i", F.coalesce(F.try_divide(F.col("_i") * F.col("_end"), F.col("_n")), F.lit(0.0)).alias("time"))
    starts = shots.where("start_s is not null").select("media_id", "start_s")
    if kernel != "exponential" and kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel!r}")
    if kernel == "exponential":
        return rescale(_two_sided(starts, grid.select("media_id", "time"), float(bandwidth), fps), keys=("media_id",))
    u = F.abs(F.col("time") - F.col("start_s")) / float(bandwidth)
    width = float(bandwidth) * (_far(bandwidth, fps, 9.0) if kernel == "gaussian" else 1.0)
    reach = starts.withColumns({"_from": F.col("start_s") - width, "_to": F.col("start_s") + width})
    near = range_join(reach, grid.select("media_id", "time"), "()", width=width, start="_from", end="_to").groupBy("media_id", "time").agg(F.sum(KERNELS[kernel](u)).alias("_y"))
    met = grid.select("media_id", "time").join(near, ["media_id", "time"], "left").select("media_id", "time", F.coalesce("_y", F.lit(0.0)).alias("y"))
    return rescale(met, keys=("media_id",))


#: Bandwidths of a bucket of the exponential kernel, whose terms there lie between exp(-SPAN) and exp(SPAN).
SPAN = 8


def _two_sided(starts: DataFrame, grid: DataFrame, h: float, fps: float) -> DataFrame:
    """(media_id, time, y): the sum of exp(-|t - s| / h) over all starts s, for the times of the grid.

    Time is cut into buckets. Inside, exp(-t) times the sum of exp(s) up to t, and the reverse from t on, are running
    sums over the merged starts and times; of each bucket's starts two numbers are sent to the buckets around it,
    each weighted by exp(-SPAN) a bucket, as far as they count.
    """
    span = SPAN * h
    both = starts.select("media_id", F.col("start_s").cast("double").alias("time"), F.lit(1).alias("one")).unionByName(grid.select("media_id", F.col("time").cast("double").alias("time"), F.lit(0).alias("one")))
    both = both.withColumn("_b", F.floor(F.col("time") / span)).withColumn("_x", (F.col("time") - F.col("_b") * span) / h)
    up, down = F.when(F.col("one") == 1, F.exp("_x")), F.when(F.col("one") == 1, F.exp(-F.col("_x")))
    ends = both.where("one = 1").groupBy("media_id", "_b").agg(F.sum(F.exp("_x")).alias("_up"), F.sum(F.exp(-F.col("_x"))).alias("_down"))
    away = math.ceil(min(760.0, 44.0 + 0.5 / (fps * h)) / SPAN)  # exp(-760) is 0
    sent = ends.withColumn("_j", F.explode(F.array(*(F.lit(j) for j in range(-away, away + 1) if j))))
    sent = sent.select(F.col("media_id").alias("_m"), (F.col("_b") + F.col("_j")).alias("_c"), F.when(F.col("_j") > 0, F.col("_up") * F.exp(-SPAN * F.col("_j"))).alias("_l"), F.when(F.col("_j") < 0, F.col("_down") * F.exp(SPAN * F.col("_j"))).alias("_r"))
    carried = sent.groupBy("_m", "_c").agg(F.coalesce(F.sum("_l"), F.lit(0.0)).alias("_left"), F.coalesce(F.sum("_r"), F.lit(0.0)).alias("_right"))
    so_far = lambda order: Window.partitionBy("media_id", "_b").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = both.withColumns({"_l": F.sum(up).over(so_far(F.col("time"))), "_r": F.sum(down).over(so_far(F.desc("time"))), "_same": F.sum("one").over(Window.partitionBy("media_id", "_b", "time"))}).where("one = 0")
    met = summed.join(carried, (F.col("media_id") == F.col("_m")) & (F.col("_b") == F.col("_c")), "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    y = F.exp(-F.col("_x")) * (some("_l") + some("_left")) + F.exp("_x") * (some("_r") + some("_right")) - F.col("_same")
    return met.groupBy("media_id", "time").agg(F.first(y).alias("y"))
