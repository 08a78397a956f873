"""Detection boxes: decoding, geometry, filters, suppression, and lines stitched from words."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import dealt


def filter_detections(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    return boxes.where(F.col("det_score") >= threshold)


def anchor_grid(df: DataFrame, strides: Sequence[int] = (8, 16, 32), anchors: int = 2) -> DataFrame:
    """(width, height, stride, anchor_idx, cx, cy) for each distinct input size: rows of a stride run along x first, `anchors` at each point."""
    sizes = df.select("width", "height").distinct().withColumn("stride", F.explode(F.array(*map(F.lit, strides))))
    n = F.floor(F.col("width") / F.col("stride")) * F.floor(F.col("height") / F.col("stride")) * anchors
    at = sizes.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("anchor_idx"))
    point = F.floor(F.col("anchor_idx") / anchors)
    columns = F.floor(F.col("width") / F.col("stride"))
    return at.withColumns({"cx": (point % columns) * F.col("stride"), "cy": F.floor(point / columns) * F.col("stride")})


def decode_boxes(raw: DataFrame, strides: Sequence[int] = (8, 16, 32), anchors: int = 2) -> DataFrame:
    """Corners (x1, y1, x2, y2), and keypoints if there, from distances to anchor points.

    raw: (width, height, stride, anchor_idx, distances ARRAY of left, top, right,
    bottom in strides[, keypoints ARRAY of x, y, x, y, ... offsets in strides]).
    """
    grid = anchor_grid(raw, strides, anchors)
    met = raw.join(F.broadcast(grid) if grid.select("width", "height").distinct().count() <= 4 else grid, ["width", "height", "stride", "anchor_idx"])
    s, d = F.col("stride"), F.col("distances")
    out = met.withColumns({"x1": F.col("cx") - d[0] * s, "y1": F.col("cy") - d[1] * s, "x2": F.col("cx") + d[2] * s, "y2": F.col("cy") + d[3] * s})
    if "keypoints" in raw.columns:
        out = out.withColumn("keypoints", F.transform("keypoints", lambda v, i: F.when(i % 2 == 0, F.col("cx")).otherwise(F.col("cy")) + v * s))
    return out.drop("cx", "cy", "distances")


def rescale_boxes(boxes: DataFrame) -> DataFrame:
    """Pixels of a scaled input to fractions of the image: x and y not under 0, all rounded half to even before.

    boxes: (x, y, w, h, scale, width, height).
    """
    pixel = lambda c: F.bround(c / F.col("scale"), 0)
    zero = F.lit(0.0)
    return boxes.withColumns({
        "x": F.bround(F.greatest(zero, F.col("x") / F.col("scale")), 0) / F.col("width"),
        "y": F.bround(F.greatest(zero, F.col("y") / F.col("scale")), 0) / F.col("height"),
        "w": pixel(F.col("w")) / F.col("width"),
        "h": pixel(F.col("h")) / F.col("height"),
    })


def letterbox_geometry(frames: DataFrame, width: int, height: int, stride: int | None = 32, grow: bool = True) -> DataFrame:
    """ratio, new_w, new_h, dw, dh: a frame (w, h) fitted into width x height; padding is halved, and modulo stride if one is given."""
    r = F.least(F.lit(height) / F.col("h"), F.lit(width) / F.col("w"))
    out = frames.withColumn("ratio", r if grow else F.least(r, F.lit(1.0)))
    out = out.withColumns({"new_w": F.bround(F.col("w") * F.col("ratio"), 0).cast("int"), "new_h": F.bround(F.col("h") * F.col("ratio"), 0).cast("int")})
    pad = lambda full, new: F.pmod(F.lit(full) - F.col(new), F.lit(stride)) if stride else F.lit(full) - F.col(new)
    return out.withColumns({"dw": pad(width, "new_w") / 2, "dh": pad(height, "new_h") / 2})


def unletterbox(boxes: DataFrame) -> DataFrame:
    """Boxes (x, y, w, h, ratio, dw, dh) back in the frame's pixels; empty ones are dropped."""
    out = boxes.withColumns({
        "x": F.bround((F.col("x") - F.col("dw")) / F.col("ratio"), 0),
        "y": F.bround((F.col("y") - F.col("dh")) / F.col("ratio"), 0),
        "w": F.bround(F.col("w") / F.col("ratio"), 0),
        "h": F.bround(F.col("h") / F.col("ratio"), 0),
    })
    return out.where((F.col("w") != 0) & (F.col("h") != 0))


def fit_geometry(frames: DataFrame, width: int, height: int) -> DataFrame:
    """scale, fit_w, fit_h (truncated), off_x, off_y: a frame (w, h) centred in width x height."""
    scale = F.least(F.lit(width) / F.col("w"), F.lit(height) / F.col("h"))
    out = frames.withColumn("scale", scale).withColumns({"fit_w": F.floor(F.col("w") * scale).cast("int"), "fit_h": F.floor(F.col("h") * scale).cast("int")})
    return out.withColumns({"off_x": F.floor((F.lit(width) - F.col("fit_w")) / 2).cast("int"), "off_y": F.floor((F.lit(height) - F.col("fit_h")) / 2).cast("int")})


def to_annotations(df: DataFrame, label: str = "label", fps: float | None = None) -> DataFrame:
    """(media_id, start_s, end_s, labels): an instant lasts delta_time, or 1 / fps."""
    step = F.lit(1.0 / fps) if fps else F.col("delta_time")
    return df.select("media_id", F.col("time").alias("start_s"), (F.col("time") + step).alias("end_s"), F.array(F.col(label)).alias("labels"))


def box_polygon(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Eight numbers: the corners clockwise from the top left."""
    return F.array(x, y, x + w, y, x + w, y + h, x, y + h)


def polygon_box(p: Column) -> Column:
    """x, y, w, h of a polygon of eight numbers."""
    xs, ys = F.array(*(p[i] for i in (0, 2, 4, 6))), F.array(*(p[i] for i in (1, 3, 5, 7)))
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))


def crop_geometry(boxes: DataFrame, size: int = 96, margin: float = 1.5, compat: bool = False) -> DataFrame:
    """cx, cy, crop_scale of a square crop round each box. compat: the centre is ((x + w) / 2, (y + h) / 2)."""
    half = 1.0 if compat else 2.0
    cx = (F.col("x") + F.col("w")) / 2 if compat else F.col("x") + F.col("w") / half
    cy = (F.col("y") + F.col("h")) / 2 if compat else F.col("y") + F.col("h") / half
    return boxes.withColumns({"cx": cx, "cy": cy, "crop_scale": F.try_divide(F.lit(float(size)), margin * F.greatest("w", "h"))})


def denormalise_keypoints(keypoints: DataFrame) -> DataFrame:
    """x and y (arrays of fractions) in pixels of the frame (width, height)."""
    return keypoints.withColumns({"x": F.transform("x", lambda v: v * F.col("width")), "y": F.transform("y", lambda v: v * F.col("height"))})


def face_size_filter(boxes: DataFrame, faces: DataFrame, images: DataFrame | None = None, keypoints: DataFrame | None = None, min_height: float = 0.1) -> dict[str, DataFrame]:
    """Boxes, faces, images and keypoints of the faces that have a box of at least min_height.

    The boxes are counted: all sides of the joins are dealt in partitions of so many of them (see skew.dealt).
    """
    n = boxes.count()
    keys = dealt(boxes.where(F.col("h") >= min_height).select(F.col("ref_id").alias("_k")), ["_k"], n).distinct()
    keep = lambda df, col: (d := dealt(df, [col], n)).join(keys, d[col] == keys["_k"], "left_semi")
    out = {"boxes": keep(boxes, "ref_id"), "faces": keep(faces, "id")}
    if images is not None:
        out["images"] = keep(images, "ref_id")
    if keypoints is not None:
        out["keypoints"] = keep(keypoints, "ref_id")
    return out


def nms(boxes: DataFrame, threshold: float = 0.4, by: Sequence[str] = ("media_id", "frame_idx"), extra: Sequence[str] = ()) -> DataFrame:
    """Greedy suppression by frame, best score first (then smallest id): a box goes if its IoU with a kept one exceeds the threshold.

    Areas and overlaps count end pixels (+ 1). One frame's boxes are one value; all runs inside Catalyst.
    """
    fields = ["x", "y", "w", "h", "det_score", "id", *extra]
    box = F.struct((-F.col("det_score")).alias("_s"), F.col("id").alias("_i"), *fields)
    framed = boxes.groupBy(*by).agg(F.array_sort(F.collect_list(box)).alias("b"))
    area = lambda b: (b["w"] + 1) * (b["h"] + 1)

    def iou(a, b):
        w = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]) + 1)
        h = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]) + 1)
        return w * h / (area(a) + area(b) - w * h)

    kept = F.aggregate("b", F.filter("b", lambda x: F.lit(False)), lambda acc, x: F.when(F.exists(acc, lambda k: iou(k, x) > threshold), acc).otherwise(F.concat(acc, F.array(x))))
    return framed.select(*by, F.explode(kept).alias("k")).select(*by, *(f"k.{f}" for f in fields))


def _same_line(a: dict, b: dict, overlap: float) -> bool:
    """Whether two boxes meet in height, in at least the share `overlap` of the lower one's height."""
    common = min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
    return common >= 0 and common >= overlap * min(a["y1"] - a["y0"], b["y1"] - b["y0"])


def _chain(rows: list[dict], gap: float, overlap: float) -> list[dict]:
    """Rows (x0, y0, x1, y1, text) as lines, each begun by the leftmost free row.

    A line takes every free row, from left to right, that is on the same line as the row it took last; then it is
    cut where the next row begins more than `gap` after the end of the one before. Equal x0 keep their order.
    """
    free, out = sorted(rows, key=lambda r: r["x0"]), []
    while free:
        line, rest = [free[0]], []
        for r in free[1:]:
            (line if _same_line(line[-1], r, overlap) else rest).append(r)
        first = 0
        for k in range(1, len(line) + 1):
            if k == len(line) or line[k]["x0"] - line[k - 1]["x1"] > gap:
                part = line[first:k]
                out.append({c: f(r[c] for r in part) for c, f in (("x0", min), ("y0", min), ("x1", max), ("y1", max))} | {"text": " ".join(r["text"] for r in part)})
                first = k
        free = rest
    return out


def _flip(rows: list[dict]) -> list[dict]:
    return [{"x0": r["y0"], "y0": r["x0"], "x1": r["y1"], "y1": r["x1"], "text": r["text"]} for r in rows]


def merge_lines(words: DataFrame, x_gap: float = 100, y_overlap: float = 0.5, y_gap: float = 10, x_overlap: float = 0.5) -> DataFrame:
    """(media_id, frame_idx, x, y, w, h, text): words of a frame stitched into lines, then lines above each other into blocks.

    The order matters, so the words of a frame, which are few, are one value; equal left edges go by id.
    """

    def run(batches):
        for f in batches:
            out = []
            for media, frame, words_ in zip(f.media_id, f.frame_idx, f["words"], strict=True):
                rows = [{"x0": r["x"], "y0": r["y"], "x1": r["x"] + r["w"], "y1": r["y"] + r["h"], "text": r["text"] or ""} for r in words_]
                done = _flip(_chain(_flip(_chain(rows, x_gap, y_overlap)), y_gap, x_overlap))
                out += [(media, frame, r["x0"], r["y0"], r["x1"] - r["x0"], r["y1"] - r["y0"], r["text"]) for r in done]
            yield pd.DataFrame(out, columns=["media_id", "frame_idx", "x", "y", "w", "h", "text"])

    kind = dict(words.dtypes)
    word = F.struct("id", "text", *(F.col(c).cast("double").alias(c) for c in "xywh"))
    framed = words.groupBy("media_id", "frame_idx").agg(F.sort_array(F.collect_list(word)).alias("words"))
    return framed.mapInPandas(run, f"media_id {kind['media_id']}, frame_idx {kind['frame_idx']}, x double, y double, w double, h double, text string")
