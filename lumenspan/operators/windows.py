"""Frame windows, batches, even samples and frame clocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .positions import numbered


def frame_grid(media: DataFrame, fps: float) -> DataFrame:
    """(media_id, frame_idx, time, delta_time) for duration * fps frames of each media (media_id, duration)."""
    n = F.floor(F.col("duration") * fps).cast("int")
    at = media.where(n > 0).select("media_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("frame_idx"))
    return at.select("media_id", "frame_idx", (F.col("frame_idx") / float(fps)).alias("time"), F.lit(1.0 / fps).alias("delta_time"))


def sliding_windows(frames: DataFrame, size: int = 100, step: int = 50, pad: int = 25) -> DataFrame:
    """(media_id, k, j, frame_idx): window k shows frames clamp(step * k - pad + j, 0, n - 1), j < size; ceil(n / step) windows."""
    n = frames.groupBy("media_id").agg(F.count("*").alias("n"))
    k = n.select("media_id", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / step).cast("int") - 1)).alias("k"))
    kj = k.select("media_id", "n", "k", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("j"))
    return kj.select("media_id", "k", "j", F.greatest(F.lit(0), F.least(F.col("n") - 1, F.col("k") * step - pad + F.col("j"))).cast("long").alias("frame_idx"))


def merge_windows(predictions: DataFrame, frames: DataFrame, step: int = 50, pad: int = 25) -> DataFrame:
    """(media_id, frame_idx, y) from predictions (media_id, k, j, y): the middle `step` of each window, cut to the media's frames."""
    n = frames.groupBy("media_id").agg(F.count("*").alias("n"))
    at = predictions.where(F.col("j").between(pad, pad + step - 1)).withColumn("frame_idx", (F.col("k") * step + F.col("j") - pad).cast("long"))
    return at.join(n, "media_id").where("frame_idx < n").select("media_id", "frame_idx", "y")


def frame_batches(frames: DataFrame, size: int = 8, fps: float | None = None) -> DataFrame:
    """(media_id, batch, time, frames, delta_time): whole batches of `size` frames, with their mean time; a short last one is dropped."""
    batch = frames.withColumn("batch", F.floor(F.col("frame_idx") / size).cast("long"))
    out = batch.groupBy("media_id", "batch").agg(F.avg("time").alias("time"), F.count("*").alias("frames")).where(F.col("frames") == size)
    return out.withColumn("delta_time", F.lit(size / fps if fps else None).cast("double"))


def resample_frames(frames: DataFrame, fps: float) -> DataFrame:
    """The first frame of each slot ceil(time * fps)."""
    slot = F.ceil(F.col("time") * fps)
    first = Window.partitionBy("media_id", "slot").orderBy("time", "frame_idx")
    return frames.withColumn("slot", slot).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def batch_rows(df: DataFrame, n: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with the number of their batch of n, in order."""
    return numbered(df, by, order).withColumn("batch", F.floor(F.col("_i") / n).cast("long")).drop("_i")


def even_sample(df: DataFrame, by: Sequence[str], order: Sequence[str], m: int = 30) -> DataFrame:
    """Rows of each group with is_sample: true at the positions round_half_even(j (n - 1) / (k - 1)), j < k = min(n, m)."""
    sizes = df.groupBy(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by))).agg(F.count(F.lit(1)).alias("_n"))
    placed = numbered(df, by, order, "_place").join(sizes, [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)])
    k = F.least(F.col("_n"), F.lit(m))
    place = F.transform(F.sequence(F.lit(0).cast("bigint"), k - 1), lambda j: F.bround(F.coalesce(F.try_divide((j * (F.col("_n") - 1)).cast("double"), (k - 1).cast("double")), F.lit(0.0)), 0).cast("bigint"))
    return placed.withColumn("is_sample", F.array_contains(place, F.col("_place"))).select(*df.columns, "is_sample")
