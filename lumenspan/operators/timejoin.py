"""Joins on time: range joins with stated bounds, nearest frames, positions, references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import shared_dir
from .positions import numbered, running
from .skew import dealt

#: The interval conventions: open, closed, half-open.
BOUNDS = ("()", "[]", "[)", "(]")


def within(t: Column, start: Column, end: Column, bounds: str) -> Column:
    if bounds not in BOUNDS:
        raise ValueError(f"bounds must be one of {BOUNDS}")
    left = t >= start if bounds[0] == "[" else t > start
    return left & (t <= end if bounds[1] == "]" else t < end)


def range_join(spans: DataFrame, points: DataFrame, bounds: str = "[)", how: str = "inner", width: float | None = None, time: str = "time", start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Points of the same media inside each span.

    Always an equi-join on media_id. For long media `width` cuts time into
    buckets: a point has one, a span has all that it touches, and the bucket
    joins the key, so a hot media is dealt over many tasks and a span meets only
    points that are near. Choose a width of the order of the spans' length.
    how: inner, or left, which keeps spans without points (any column may be null).
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    p = points.withColumnRenamed("media_id", "_m")
    on = F.col("media_id") == F.col("_m")
    if width:
        p = p.withColumn("_b", F.floor(F.col(time) / width))
        own = [*spans.columns]
        cut = spans.withColumn("_sb", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(start, end) / width))))
        met = cut.join(p, on & (F.col("_sb") == F.col("_b")) & within(F.col(time), F.col(start), F.col(end), bounds)).drop("_m", "_b", "_sb")
        if how == "inner":
            return met
        names = {c: f"_o{i}" for i, c in enumerate(own)}
        some = met.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())).distinct()
        alone = spans.join(some, [F.col(f"`{c}`").eqNullSafe(F.col(n)) for c, n in names.items()], "left_anti")
        return met.unionByName(alone, allowMissingColumns=True)
    return spans.join(p, on & within(F.col(time), F.col(start), F.col(end), bounds), how).drop("_m")


def timeline_sampler(shots: DataFrame, frames: DataFrame, middle: bool = True, start: bool = False, end: bool = False, mode: str = "nearest", width: float | None = None) -> DataFrame:
    """(media_id, shot_idx, pick, time, frame_idx): for each shot the frame nearest to its start, middle and end.

    Candidates lie in [start_s, end_s]; the earlier frame wins ties; a shot
    without candidates has no rows. mode "scan" takes each frame for one shot
    only: shots are met in order, and the first frame at or after a shot's end
    closes it and is not used again. width: buckets of the range join, as there.
    """
    picks = [p for p, on in (("start", start), ("middle", middle), ("end", end)) if on]
    if mode == "scan":
        return _scan(shots, frames, picks)
    met = range_join(shots, frames.select("media_id", "time", "frame_idx"), "[]", width=width)
    goal = {"start": F.col("start_s"), "middle": (F.col("start_s") + F.col("end_s")) / 2, "end": F.col("end_s")}
    best = met.groupBy("media_id", "shot_idx").agg(*(F.min_by(F.struct("time", "frame_idx"), F.struct(F.abs(F.col("time") - goal[p]), F.col("time"), F.col("frame_idx"))).alias(p) for p in picks))
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("pick_idx"), F.lit(p).alias("pick"), F.col(p).alias("f")) for i, p in enumerate(picks))))
    return best.select("media_id", "shot_idx", rows.alias("r")).select("media_id", "shot_idx", "r.pick", "r.f.time", "r.f.frame_idx")


def _scan(shots: DataFrame, frames: DataFrame, picks: list[str]) -> DataFrame:
    """The scan without a scan: where a shot begins depends on those before it by a running maximum alone.

    With o and c the number of frames before a shot's start and its end, shot k takes the frames from first = max(o, free)
    to last = max(first, c), and free = last + 1 for the next. So free is k + 1 plus the largest max(o, c) - j of all
    shots j up to k: two running values along the media, each in two levels, in place of one task a media.
    """
    shared_dir(shots.sparkSession)
    frames = frames.where("media_id is not null and time is not null").select("media_id", F.col("time").cast("double").alias("time"), "frame_idx")
    shots = shots.where("media_id is not null and start_s is not null and end_s is not null").select("media_id", "shot_idx", F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"))
    shots = shots.withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    # frames before each start, middle and end, and those up to each end; events of one time: 0 before its frames, 2 after
    at = F.explode(F.array(*(F.struct(F.lit(n).alias("what"), t.alias("time"), F.lit(side).alias("side")) for n, t, side in (("opens", F.col("start_s"), 0), ("middle", (F.col("start_s") + F.col("end_s")) / 2, 0), ("closes", F.col("end_s"), 0), ("within", F.col("end_s"), 2)))))
    events = shots.select("media_id", "_id", at.alias("e")).select("media_id", "_id", "e.what", "e.time", "e.side")
    along = running(frames.withColumn("side", F.lit(1)).unionByName(events, allowMissingColumns=True), ["media_id"], ["time", "side", "frame_idx"], {"seen": F.when(F.col("side") == 1, 1).otherwise(0)})
    placed = along.where("side = 1").select("media_id", F.col("seen").alias("place"), "time", "frame_idx").withColumn("place", F.col("place") - 1)
    counts = along.where("side <> 1").groupBy("_id").agg(*(F.max(F.when(F.col("what") == n, F.col("seen"))).alias(n) for n in ("opens", "middle", "closes", "within")))
    in_order = numbered(shots.join(counts, "_id"), ["media_id"], ["start_s", "shot_idx"], "k").withColumn("_top", F.greatest("opens", "closes") - F.col("k"))
    known = running(in_order, ["media_id"], ["k"], tops={"top": F.col("_top")})
    # free before shot k: that after shot k - 1, whose top is this shot's without itself
    before = known.select(F.col("media_id").alias("_m"), (F.col("k") + 1).alias("_k"), (F.col("k") + 1 + F.col("top")).alias("free"))
    chain = known.join(before, (F.col("media_id") == F.col("_m")) & (F.col("k") == F.col("_k")), "left")
    chain = chain.withColumn("first", F.greatest("opens", F.coalesce("free", F.lit(0)))).withColumn("high", F.least(F.greatest("first", "closes"), F.col("within") - 1)).where("first <= high")
    clamp = lambda c: F.greatest("first", F.least(c, F.col("high")))
    goals = {"start": (F.col("start_s"), [F.col("first")]), "middle": ((F.col("start_s") + F.col("end_s")) / 2, [clamp(F.col("middle") - 1), clamp(F.col("middle"))]), "end": (F.col("end_s"), [F.col("high")])}
    asked = F.explode(F.array(*(F.struct(F.lit(p).alias("pick"), goals[p][0].alias("goal"), c.alias("place")) for p in picks for c in goals[p][1])))
    asked = chain.select("media_id", "_id", "shot_idx", "first", asked.alias("a")).select("media_id", "_id", "shot_idx", "first", "a.*")
    # of frames of one time the first counts
    ties = placed.groupBy(F.col("media_id").alias("_tm"), F.col("time").alias("_tt")).agg(F.min("place").alias("_first"))
    near = asked.join(placed.select("media_id", "place", "time"), ["media_id", "place"])
    best = near.groupBy("media_id", "_id", "shot_idx", "pick", "first").agg(F.min_by("time", F.struct(F.abs(F.col("time") - F.col("goal")), F.col("place"))).alias("time"))
    chosen = best.join(ties, (F.col("media_id") == F.col("_tm")) & (F.col("time") == F.col("_tt"))).withColumn("place", F.greatest("first", "_first"))
    return chosen.select("media_id", "shot_idx", "pick", "time", "place").join(placed.select("media_id", "place", "frame_idx"), ["media_id", "place"]).select("media_id", "shot_idx", "pick", "time", "frame_idx")


def zip_rows(a: DataFrame, b: DataFrame, order_a: Sequence[str], order_b: Sequence[str], by: str = "media_id") -> DataFrame:
    """Row i of a media in a with row i in b; what is left over is dropped."""
    return numbered(a, [by], order_a).join(numbered(b, [by], order_b), [by, "_i"]).withColumn("idx", F.col("_i").cast("int")).drop("_i")


def frames_at(frames: DataFrame, items: DataFrame, fps: float | None = None) -> DataFrame:
    """Frames joined to boxes or keypoints of the same media and frame; with fps the frame is found from `time`."""
    if fps:
        slot = F.bround(F.col("time") * fps, 0).cast("long")
        frames, items = frames.withColumn("frame_idx", slot), items.withColumn("frame_idx", slot).drop("time")
    return items.join(frames, ["media_id", "frame_idx"])


def face_crops(images: DataFrame, faces: DataFrame, keypoints: DataFrame, seq: str = "seq") -> DataFrame:
    """(face_id, image_id, x, y): the last keypoints of each face, with the image that the face refers to.

    The last keypoints are found by sorting, so these are counted and dealt first (see skew.dealt).
    """
    last = dealt(keypoints, ["ref_id"], keypoints.count()).groupBy(F.col("ref_id").alias("face_id")).agg(F.max_by(F.struct("x", "y"), seq).alias("k"))
    linked = faces.select(F.col("id").alias("face_id"), F.col("ref_id").alias("image_id"))
    return last.join(linked, "face_id").join(images.select(F.col("id").alias("image_id")), "image_id").select("face_id", "image_id", "k.x", "k.y")


def resolve_refs(scores: DataFrame, images: DataFrame) -> DataFrame:
    """Scores with the ref_id of their image, null where there is none; the score's own ref_id stays as item_ref_id."""
    look = images.select(F.col("id").alias("image_id"), F.col("ref_id"))
    kept = scores.withColumnRenamed("ref_id", "item_ref_id") if "ref_id" in scores.columns else scores
    return kept.join(look, "image_id", "left")
