"""Operators along one long media: places and running values in two levels, the scan, and kernels in linear time."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.operators import positions, shots, timejoin, windows


def crowded(n=4_000):
    """One media with almost all rows, many of them of one time, and rows of a null media."""
    rng = np.random.default_rng(0)
    time = np.where(rng.random(n) < 0.3, 7.0, rng.integers(0, 500, n))
    return [("hot", float(t), i) for i, t in enumerate(time)] + [("b", 1.0, n), ("b", 0.5, n + 1), (None, 2.0, n + 2), (None, None, n + 3)]


def test_places_of_a_long_media(spark):
    rows = crowded()
    df = spark.createDataFrame(rows, "media_id string, time double, id long").repartition(3)
    got = positions.numbered(df, ["media_id"], ["time", "id"]).collect()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    want = {r[2]: k for m in {r[0] for r in rows} for k, r in enumerate(sorted((x for x in rows if x[0] == m), key=key))}
    assert {r.id: r._i for r in got} == want
    # rows of one time are dealt over tasks as well
    parts = positions._sorted(df, ["media_id"], ["time"]).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 3 and max(r["count"] for r in parts) < 0.5 * len(rows)


def test_running_values(spark):
    rows = crowded(600)
    df = spark.createDataFrame(rows, "media_id string, time double, id long")
    got = positions.running(df, ["media_id"], ["time", "id"], {"s": F.when(F.col("id") % 2 == 0, F.col("id"))}, {"m": F.when(F.col("id") % 3 == 0, F.col("id"))}).collect()
    for m in {r[0] for r in rows}:
        total, top = 0, None
        for r in sorted((x for x in got if x.media_id == m), key=lambda r: (r.time is not None, r.time or 0, r.id)):
            total += r.id if r.id % 2 == 0 else 0
            top = max(x for x in (top, r.id) if x is not None) if r.id % 3 == 0 else top
            assert (r.s, r.m) == (total, top)


def test_rows_in_step_and_batches(spark):
    rows = crowded(500)
    df = spark.createDataFrame(rows, "media_id string, time double, id long")
    other = df.where("id % 5 <> 0").select("media_id", F.col("time").alias("t"), F.col("id").alias("other"))
    got = timejoin.zip_rows(df, other, ["time", "id"], ["t", "other"]).where("media_id = 'hot'").orderBy("idx").collect()
    a = sorted((r[1:] for r in rows if r[0] == "hot"))
    b = [x for x in a if x[1] % 5]
    assert [(r.id, r.other, r.idx) for r in got] == [(x[1], y[1], i) for i, (x, y) in enumerate(zip(a, b, strict=False))]
    batches = windows.batch_rows(df, 7, ["media_id"], ["time", "id"]).where("media_id = 'hot'").collect()
    place = {x[1]: i for i, x in enumerate(a)}
    assert all(r.batch == place[r.id] // 7 for r in batches)
    sampled = windows.even_sample(df, ["media_id"], ["time", "id"], 11).where("media_id = 'hot' and is_sample").collect()
    assert sorted(place[r.id] for r in sampled) == sorted({round(j * (len(a) - 1) / 10) for j in range(11)})


def scanned(shots_, frames_):
    """The scan as a loop over shots and frames."""
    out = []
    for m in sorted({s[0] for s in shots_}):
        own = sorted((t, i) for x, t, i in frames_ if x == m)
        free = 0
        for _, idx, start, end in sorted((s for s in shots_ if s[0] == m), key=lambda s: (s[2], s[1])):
            first = max(free, sum(t < start for t, _ in own))
            last = max(first, sum(t < end for t, _ in own))
            free = last + 1
            near = [f for f in own[first : last + 1] if f[0] <= end]
            if near:
                for pick, goal in (("start", start), ("middle", (start + end) / 2), ("end", end)):
                    t, i = min(near, key=lambda f, goal=goal: (abs(f[0] - goal), near.index(f)))
                    out.append((m, idx, pick, t, i))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_scan_against_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    frames_ = [("a", float(t), i) for i, t in enumerate(rng.integers(0, 120, 150))] + [("b", float(t), i) for i, t in enumerate(rng.integers(0, 30, 12))]
    spans = [(m, i, float(s), float(s) + float(rng.integers(0, w))) for m, n, top, w in (("a", 60, 130, 12), ("b", 9, 40, 9), ("c", 2, 9, 3)) for i, s in enumerate(rng.integers(0, top, n))]
    s = spark.createDataFrame(spans + [(None, 1, 0.0, 9.0), ("a", 99, None, 5.0)], "media_id string, shot_idx int, start_s double, end_s double")
    f = spark.createDataFrame(frames_ + [("a", None, 999), (None, 1.0, 1)], "media_id string, time double, frame_idx int")
    got = timejoin.timeline_sampler(s, f, True, True, True, mode="scan")
    assert sorted(tuple(r) for r in got.select("media_id", "shot_idx", "pick", "time", "frame_idx").collect()) == scanned(spans, frames_)


def density(starts, end, kernel, h, fps):
    n = math.ceil(end * fps)
    t = np.arange(n + 1) * end / n
    u = np.abs(t[:, None] - np.array(starts)[None]) / h
    y = {"gaussian": np.exp(-0.5 * u * u), "exponential": np.exp(-u)}[kernel].sum(1)
    return (y - y.min()) / (y.max() - y.min())


@pytest.mark.parametrize("kernel", ["gaussian", "exponential"])
@pytest.mark.parametrize("h,fps", [(30.0, 2.0), (1.0, 2.0), (0.2, 1.0), (500.0, 0.5)])
def test_kernels_without_end(spark, kernel, h, fps):
    rng = np.random.default_rng(1)
    starts = [0.0, 3.0, 3.0, *np.sort(rng.random(60) * 900).round(1), 2_000.0]
    rows = [("m", i, float(s), float(s) + 1) for i, s in enumerate(starts)] + [("m", 99, None, 2_100.0), ("z", 0, None, 1.0)]
    df = spark.createDataFrame(rows, "media_id string, shot_idx int, start_s double, end_s double")
    got = shots.shot_density(df, kernel, h, fps).where("media_id = 'm'").orderBy("time").toPandas()
    assert np.abs(got.y.to_numpy() - density(starts, 2_100.0, kernel, h, fps)).max() < 1e-9
    assert shots.shot_density(df, kernel, h, fps).where("media_id = 'z' and y is not null").count() == 0


def test_kernels_grow_in_proportion(spark, monkeypatch):
    met = []

    def counted(*a, **k):
        met.append(timejoin.range_join(*a, **k).count())
        return timejoin.range_join(*a, **k)

    monkeypatch.setattr(shots, "range_join", counted)
    for n in (300, 3_000):
        df = spark.range(n).select(F.lit("m").alias("media_id"), F.col("id").alias("shot_idx"), (F.col("id") * 10.0).alias("start_s"), (F.col("id") * 10.0 + 9).alias("end_s"))
        for kernel in ("gaussian", "tophat"):
            shots.shot_density(df, kernel, 20.0, 0.5)
        rows = shots._two_sided(df.select("media_id", "start_s"), df.select("media_id", F.col("start_s").alias("time")), 20.0, 0.5)
        assert rows.count() == n
    assert met[2] < 11 * met[0] and met[3] < 11 * met[1]
    with pytest.raises(ValueError):
        shots.shot_density(df, "square")
