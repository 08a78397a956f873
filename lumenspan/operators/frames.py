"""Frame sizes and colours from decoded pixels (media_id, frame_idx, r, g, b)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import rescale


def scaled_size(media: DataFrame, max_dim: int | None = None, size: tuple[int, int] | None = None) -> DataFrame:
    """out_w, out_h: (w, h) scaled down to a longest side of max_dim and rounded; or a fixed size."""
    if size:
        return media.withColumns({"out_w": F.lit(size[0]), "out_h": F.lit(size[1])})
    s = F.least(F.lit(float(max_dim)) / F.greatest("w", "h"), F.lit(1.0)) if max_dim else F.lit(1.0)
    return media.withColumns({"out_w": F.bround(F.col("w") * s, 0).cast("int"), "out_h": F.bround(F.col("h") * s, 0).cast("int")})


def frame_geometry(frames: DataFrame, op: str, size: int = 0, roi: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Bounds of a resize, crop, pad or region of frames (w, h).

    max: out_w, out_h with the longer side at most `size`; min: with the shorter
    side at least `size` (both truncated); crop: x0, y0, x1, y1 of a centred
    square of `size`; pad: pad_x, pad_y on each side to a square; roi: pixel
    bounds of relative x, y, w, h.
    """
    w, h = F.col("w"), F.col("h")
    if op in ("max", "min"):
        s = F.least(F.lit(float(size)) / F.greatest(w, h), F.lit(1.0)) if op == "max" else F.greatest(F.lit(float(size)) / F.least(w, h), F.lit(1.0))
        return frames.withColumns({"out_w": F.floor(w * s).cast("int"), "out_h": F.floor(h * s).cast("int")})
    if op == "crop":
        x0, y0 = F.greatest(F.lit(0), F.floor((w - size) / 2).cast("int")), F.greatest(F.lit(0), F.floor((h - size) / 2).cast("int"))
        return frames.withColumns({"x0": x0, "y0": y0, "x1": F.least(w, x0 + size).cast("int"), "y1": F.least(h, y0 + size).cast("int")})
    if op == "pad":
        return frames.withColumns({"pad_x": F.greatest(F.lit(0), F.floor((h - w) / 2).cast("int")), "pad_y": F.greatest(F.lit(0), F.floor((w - h) / 2).cast("int"))})
    if op == "roi" and roi:
        x, y, rw, rh = roi
        return frames.withColumns({"x0": F.floor(w * x).cast("int"), "y0": F.floor(h * y).cast("int"), "x1": F.floor(w * (x + rw)).cast("int"), "y1": F.floor(h * (y + rh)).cast("int")})
    raise ValueError(f"unknown geometry {op!r}")


def brightness(pixels: DataFrame, fps: float = 5.0, normalize: bool = True) -> DataFrame:
    """(media_id, time, y): mean of max(r, g, b) / 255 of each frame, rescaled to 0..1 by media if asked."""
    y = pixels.groupBy("media_id", "frame_idx").agg((F.avg(F.greatest("r", "g", "b")) / 255).alias("y"))
    out = y.select("media_id", (F.col("frame_idx") / float(fps)).alias("time"), "y")
    return rescale(out, keys=("media_id",), normalize=normalize)


def dominant_colors(pixels: DataFrame, k: int = 1, fps: float = 5.0, max_iter: int = 10) -> DataFrame:
    """(media_id, rank, time, r, g, b) in 0..1: k colours of each frame by ascending number of pixels; one is the mean.

    Beyond one colour they are the centres of weighted k-means over the frame's distinct colours, which are counted
    first. The first start is the most frequent colour, each next one the colour whose pixels times squared distance to
    the starts so far is largest; the smaller (r, g, b) wins ties. After max_iter steps, in which a colour goes to the
    nearest centre (the earlier start of equal ones) and a centre without colours stays, centres are ordered by pixels,
    then by r, g, b. A frame of fewer distinct colours has these.
    """
    time = (F.col("frame_idx") / float(fps)).alias("time")
    if k == 1:
        mean = pixels.groupBy("media_id", "frame_idx").agg(*((F.avg(c) / 255).alias(c) for c in "rgb"))
        return mean.select("media_id", F.lit(0).alias("rank"), time, "r", "g", "b")
    kinds = dict(pixels.dtypes)
    names = ["media_id", "rank", "time", "r", "g", "b"]

    def run(batches):
        for b in batches:
            lists = b.column(b.schema.get_field_index("pixels"))
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.flatten()
            x = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in "rgb"], 1)
            n = flat.field("n").to_numpy(zero_copy_only=False).astype(float)
            frame, centre, colours = _centres(x, n, offsets - offsets[0], k, max_iter)
            rows = pa.array(frame)
            at = b.column(b.schema.get_field_index("frame_idx")).take(rows).to_numpy(zero_copy_only=False) / float(fps)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("media_id")).take(rows), pa.array(centre.astype(np.int32)), pa.array(at), *(pa.array(colours[:, j] / 255) for j in range(3))], names)

    counted = pixels.na.drop(subset=["r", "g", "b"]).groupBy("media_id", "frame_idx", "r", "g", "b").agg(F.count("*").alias("n"))
    pixel = F.struct((-F.col("n")).alias("_n"), "r", "g", "b", "n")
    framed = counted.groupBy("media_id", "frame_idx").agg(F.sort_array(F.collect_list(pixel)).alias("pixels"))
    return framed.mapInArrow(run, f"media_id {kinds['media_id']}, rank int, time double, r double, g double, b double")


def _centres(x: np.ndarray, n: np.ndarray, offsets: np.ndarray, k: int, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frame, rank, centre) of frames whose colours x, n times each, lie in a row from offsets to offsets."""
    size = np.diff(offsets)
    frames = np.arange(len(size))
    of = np.repeat(frames, size)
    begin = offsets[:-1]
    distance = lambda c: ((x - c[of]) ** 2).sum(1)
    centres = np.full((len(size), k, 3), np.inf)
    centres[:, 0] = x[begin]
    near = distance(centres[:, 0])
    for j in range(1, k):
        gain = near * n
        best = np.maximum.reduceat(gain, begin)
        first = np.minimum.reduceat(np.where(gain == best[of], np.arange(len(x)), len(x)), begin)
        some = size > j
        centres[some, j] = x[first[some]]
        near = np.minimum(near, distance(centres[:, j]))

    def assign():
        return of * k + np.stack([distance(centres[:, j]) for j in range(k)], 1).argmin(1)

    for _ in range(steps):
        at = assign()
        total = np.bincount(at, n, len(size) * k)
        mean = np.stack([np.bincount(at, n * x[:, j], len(size) * k) for j in range(3)], 1) / np.maximum(total, 1)[:, None]
        new = np.where(total[:, None] > 0, mean, centres.reshape(-1, 3)).reshape(centres.shape)
        if (new == centres).all():
            break
        centres = new
    total = np.bincount(assign(), n, len(size) * k)
    flat, frame = centres.reshape(-1, 3), np.repeat(frames, k)
    there = np.tile(np.arange(k), len(size)) < np.repeat(size, k)
    order = np.lexsort((flat[:, 2], flat[:, 1], flat[:, 0], total, frame))
    order = order[there[order]]
    held = np.minimum(size, k)
    return frame[order], np.arange(len(order)) - np.repeat(np.cumsum(held) - held, held), flat[order]
