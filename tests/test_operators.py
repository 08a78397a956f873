"""Edge rules of the operators on hand-made rows."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenspan.functions import text as X
from lumenspan.functions import vectors as V
from lumenspan.operators import audio, boxes, frames, graph, series, shots, similarity, timejoin, windows
from lumenspan.operators.infer import infer
from lumenspan.operators.skew import join_counted
from lumenspan.plans import registry
from lumenspan.schemas import SchemaMismatch, conform
from lumenspan.sources import ingest
from lumenspan.sources.ingest import with_sha1
from lumenspan.streaming.ingest import dedup_within, ingest_stream, merge_batch, reassemble_stream, stored_hashes

S = "media_id string, label string, time double, y double"


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_threshold_zero_is_a_bound_unless_compat(spark):
    df = spark.createDataFrame([("a", "x", 0.0, -1.0), ("a", "x", 1.0, 2.0)], S)
    assert values(series.scalar_threshold(df, min=0), "y") == [(0.0,), (2.0,)]
    assert values(series.scalar_threshold(df, min=0, compat=True), "y") == [(-1.0,), (2.0,)]


def test_rescale_of_constant_and_narrow_series(spark):
    df = spark.createDataFrame([("a", "x", 0.0, 5.0), ("a", "x", 1.0, 5.0), ("a", "z", 0.0, 0.5), ("a", "z", 1.0, 0.5099)], S)
    assert {r.y for r in series.rescale(df).where("label = 'x'").collect()} == {None}
    assert values(series.min_max_norm(df).where("label = 'z'"), "y") == [(0.5,), (0.5099,)]
    assert {r.y for r in series.invert_scalar(df).where("label = 'x'").collect()} == {None}


def test_whole_series_operators_refuse_streams(spark):
    stream = spark.readStream.format("rate").load().select(F.lit("a").alias("media_id"), F.lit("x").alias("label"), F.lit(0.0).alias("time"), F.col("value").cast("double").alias("y"))
    for f in (series.min_max_norm, series.invert_scalar, series.rescale):
        with pytest.raises(ValueError):
            f(stream)
    assert series.scalar_threshold(stream, 0, 1).isStreaming


def test_interpolation_holds_ends_and_is_identity_on_its_grid(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 10.0), ("a", "x", 3.0, 20.0)], S)
    grid = spark.createDataFrame([("a", "x", t) for t in (0.0, 1.0, 2.0, 3.0, 9.0)], "media_id string, label string, time double")
    assert values(series.interpolate(df, grid), "time", "y") == [(0.0, 10.0), (1.0, 10.0), (2.0, 15.0), (3.0, 20.0), (9.0, 20.0)]


@pytest.mark.parametrize(("how", "want"), [("or", 0.75), ("and", 0.25), ("prod", 0.25), ("mean", 0.5), ("odd", 0.5)])
def test_combinations(spark, how, want):
    df = spark.createDataFrame([("a", "x", 0.0, 0.5), ("a", "z", 0.0, 0.5)], S)
    assert values(series.aggregate_scalar(df, how), "y") == [(want,)]


@pytest.mark.parametrize(("bounds", "want"), [("()", [2.0]), ("[]", [1.0, 2.0, 3.0]), ("[)", [1.0, 2.0]), ("(]", [2.0, 3.0])])
@pytest.mark.parametrize("width", [None, 0.7])
def test_interval_bounds(spark, bounds, want, width):
    spans = spark.createDataFrame([("a", 0, 1.0, 3.0)], "media_id string, shot_idx int, start_s double, end_s double")
    points = spark.createDataFrame([("a", float(t)) for t in range(5)] + [("b", 2.0)], "media_id string, time double")
    assert [r[0] for r in values(timejoin.range_join(spans, points, bounds, width=width), "time")] == want


def test_left_range_join_keeps_empty_spans(spark):
    spans = spark.createDataFrame([("a", 0, 1.0, 3.0), ("a", 1, 8.0, 9.0)], "media_id string, shot_idx int, start_s double, end_s double")
    points = spark.createDataFrame([("a", 2.0)], "media_id string, time double")
    for width in (None, 1.0):
        assert [r[0] for r in values(timejoin.range_join(spans, points, "[]", "left", width=width), "shot_idx")] == [0, 1]


def test_left_range_join_with_null_columns_and_bounds(spark):
    spans = spark.createDataFrame([("a", 0, 1.0, 3.0, None), ("a", 1, None, 9.0, "x"), (None, 2, 0.0, 1.0, None)], "media_id string, shot_idx int, start_s double, end_s double, note string")
    points = spark.createDataFrame([("a", 2.0), ("a", None)], "media_id string, time double")
    for width in (None, 1.0):
        assert sorted(map(tuple, timejoin.range_join(spans, points, "[]", "left", width).select("shot_idx", "time").collect())) == [(0, 2.0), (1, None), (2, None)]
    with pytest.raises(ValueError):
        timejoin.range_join(spans, points, how="right", width=1.0)


def test_width_changes_nothing(spark):
    rng = np.random.default_rng(1)
    s = spark.createDataFrame([("m", i, float(a), float(a + b)) for i, (a, b) in enumerate(zip(rng.integers(0, 90, 25), rng.integers(1, 30, 25), strict=True))], "media_id string, shot_idx int, start_s double, end_s double")
    p = spark.createDataFrame([("m", "ab"[i % 2], i % 2, float(t), float(y)) for i, (t, y) in enumerate(zip(rng.integers(0, 120, 60), rng.random(60), strict=True))], "media_id string, label string, label_idx int, time double, y double")
    texts = p.select("media_id", "time", F.col("label").alias("text"))
    labels = s.select("media_id", "shot_idx", F.lit("l").alias("label"))
    scored = p.withColumns({"i": F.col("time").cast("int")}).groupBy("media_id", "i").agg(F.max("y").alias("y"))
    both = [
        lambda w: shots.shots_from_scores(scored, 0.6, width=w and int(w)),
        lambda w: shots.shot_annotator(s, p, width=w), lambda w: shots.shot_texts(s, texts, width=w).withColumn("texts", F.array_join("texts", ",")),
        lambda w: shots.face_shot_labels(s, labels, p.where("time > 60"), width=w), lambda w: timejoin.timeline_sampler(s, p.withColumn("frame_idx", F.col("label_idx")), True, True, True, width=w),
        lambda w: series.interpolate(p, s.select("media_id", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("none"))).alias("label"), (F.col("start_s") * 3 - 40).alias("time")), width=w),
    ]
    rounded = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    for f in both:
        want = rounded(f(None))
        assert want and rounded(f(7.0)) == want


def test_density_kernels(spark):
    s = spark.createDataFrame([("m", float(a), 60.0) for a in (0, 3, 10, 59)] + [("n", 5.0, 5.0)], "media_id string, start_s double, end_s double")
    for kernel in shots.KERNELS:
        got = {r.time: r.y for r in shots.shot_density(s, kernel, 4.0, 2.0).where("media_id = 'm'").collect()}
        shape = {"gaussian": lambda u: np.exp(-u * u / 2), "exponential": lambda u: np.exp(-u), "tophat": lambda u: (u < 1) * 1.0, "epanechnikov": lambda u: (u < 1) * (1 - u * u), "linear": lambda u: (u < 1) * (1 - u), "cosine": lambda u: (u < 1) * np.cos(u * np.pi / 2)}[kernel]
        t = np.arange(121) / 2
        y = shape(np.abs(t[:, None] - np.array([0, 3, 10, 59])) / 4).sum(1)
        assert np.allclose([got[x] for x in t], (y - y.min()) / (y.max() - y.min()), atol=1e-9)


def test_clusters_of_many_copies(spark):
    v = [[1.0, 0.0]] * 40 + [[0.99, 0.1]] * 3 + [[0.0, 1.0]] * 5 + [[0.0, 0.0]] * 4 + [None]
    e = spark.createDataFrame([("m", i, x) for i, x in enumerate(v)] + [("n", 100, [1.0, 0.0])], "media_id string, id long, embedding array<double>")
    got = dict(similarity.cluster_labels(e, 0.1).select("id", "cluster_id").collect())
    assert got == {**dict.fromkeys(range(43), 0), **dict.fromkeys(range(43, 48), 43), **{i: i for i in range(48, 53)}, 100: 100}
    by_distance = dict(similarity.cluster_labels(e, 0.2, "euclidean").select("id", "cluster_id").collect())
    assert by_distance == {**got, **dict.fromkeys(range(48, 52), 48)}


def test_sampler_ties_and_scan(spark):
    s = spark.createDataFrame([("a", 0, 0.0, 4.0), ("a", 1, 4.0, 8.0), ("a", 2, 20.0, 21.0)], "media_id string, shot_idx int, start_s double, end_s double")
    f = spark.createDataFrame([("a", i, t) for i, t in enumerate([1.0, 3.0, 4.0, 6.0])], "media_id string, frame_idx int, time double")
    near = values(timejoin.timeline_sampler(s, f, True, True, True), "shot_idx", "pick", "frame_idx")
    assert near == [(0, "end", 2), (0, "middle", 0), (0, "start", 0), (1, "end", 3), (1, "middle", 3), (1, "start", 2)]
    scan = values(timejoin.timeline_sampler(s, f, True, True, True, mode="scan"), "shot_idx", "pick", "frame_idx")
    assert scan == [(0, "end", 2), (0, "middle", 0), (0, "start", 0), (1, "end", 3), (1, "middle", 3), (1, "start", 3)]


@pytest.mark.parametrize(("y", "want"), [([0, 0, 1, 0, 0], [(0, 0.0, 2.0), (1, 3.0, 4.0)]), ([1, 1, 1], [(0, 0.0, 2.0)]), ([0, 0, 0], [(0, 0.0, 2.0)]), ([1, 0], [(0, 1.0, 1.0)])])
def test_scene_runs(spark, y, want):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "media_id string, i int, y double")
    assert values(shots.shots_from_scores(df), "shot_idx", "start_s", "end_s") == want


def test_shot_annotator_ties_and_zero_means(spark):
    s = spark.createDataFrame([("a", 0, 0.0, 2.0), ("a", 1, 2.0, 4.0)], "media_id string, shot_idx int, start_s double, end_s double")
    p = spark.createDataFrame([("a", "x", 0, 1.0, 0.5), ("a", "z", 1, 1.0, 0.5), ("a", "x", 0, 3.0, 0.0)], "media_id string, label string, label_idx int, time double, y double")
    assert values(shots.shot_annotator(s, p), "shot_idx", "label") == [(0, "x")]


def test_face_labels(spark):
    s = spark.createDataFrame([("a", 0, 0.0, 2.0), ("a", 1, 2.0, 4.0)], "media_id string, shot_idx int, start_s double, end_s double")
    labels = spark.createDataFrame([("a", 0, "LS"), ("a", 1, "CU")], "media_id string, shot_idx int, label string")
    b = spark.createDataFrame([("a", 2.0)], "media_id string, time double")
    assert values(shots.face_shot_labels(s, labels, b), "shot_idx", "label") == [(0, "None"), (1, "CU")]


@pytest.mark.parametrize("kernel", sorted(shots.KERNELS))
def test_density_runs_from_0_to_1(spark, kernel):
    s = spark.createDataFrame([("a", 0, 0.0, 5.0), ("a", 1, 5.0, 90.0)], "media_id string, shot_idx int, start_s double, end_s double")
    y = [r.y for r in shots.shot_density(s, kernel, 30, 1).collect()]
    assert len(y) == 91 and min(y) == 0 and max(y) == 1


@pytest.mark.parametrize("n", [50, 51, 99, 100])
def test_overlapping_windows_cover_each_frame_once(spark, n):
    f = spark.range(n).select(F.lit("a").alias("media_id"), F.col("id").alias("frame_idx"))
    w = windows.sliding_windows(f)
    assert w.select("k").distinct().count() == math.ceil(n / 50)
    merged = windows.merge_windows(w.withColumn("y", F.col("frame_idx").cast("double")), f)
    assert values(merged, "frame_idx", "y") == [(i, float(i)) for i in range(n)]


@pytest.mark.parametrize(("n", "want"), [(7, 0), (8, 1), (9, 1)])
def test_short_batches_are_dropped(spark, n, want):
    f = spark.range(n).select(F.lit("a").alias("media_id"), F.col("id").alias("frame_idx"), F.col("id").cast("double").alias("time"))
    assert windows.frame_batches(f).count() == want


@pytest.mark.parametrize("n", [1, 2, 30, 31, 60])
def test_even_sample(spark, n):
    f = spark.range(n).select(F.lit("a").alias("g"), "id")
    got = [r.id for r in windows.even_sample(f, ["g"], ["id"]).where("is_sample").orderBy("id").collect()]
    assert got == sorted({round(x) for x in np.linspace(0, n - 1, min(n, 30))})


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    r = df.select(V.l2_normalise(F.col("a")).alias("u"), V.l2_normalise(F.col("z")).alias("zero"), V.cosine(F.col("a"), F.col("z")).alias("c"), V.softmax_array(F.array(F.lit(1000.0), F.lit(999.0))).alias("s")).first()
    assert r.u == [0.6, 0.8] and r.zero == [0.0, 0.0] and r.c is None and abs(r.s[0] - 1 / (1 + math.exp(-1))) < 1e-12


def brute_components(n, edges):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(60, 79)]
    want = brute_components(80, edges)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(want[k] == v for k, v in got.items()) and {a for a, b in edges if a != b} <= set(got)


def test_clusters_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i % 2), i, i, [float(x) for x in rng.normal(size=6)]) for i in range(80)]
    df = spark.createDataFrame(rows, "media_id int, id long, ref_id long, embedding array<double>")
    small = values(similarity.similar_pairs(df, 0.4, block=16), "a", "b")
    assert small == values(similarity.similar_pairs(df, 0.4), "a", "b") and small
    near = values(similarity.similar_pairs(df, 1.0, "euclidean", block=16), "a", "b")
    x = {r[1]: (r[0], np.array(r[3])) for r in rows}
    assert near == sorted((a, b) for a in x for b in x if a < b and x[a][0] == x[b][0] and np.linalg.norm(x[a][1] - x[b][1]) <= 1.0)
    built = similarity.build_clusters(similarity.cluster_labels(df, 0.4), df)
    assert built.count() == 80 and similarity.top_clusters(built, 1).select("media_id", "cluster_id").distinct().count() == 2


def test_nms_at_the_threshold(spark):
    b = spark.createDataFrame([("a", 0, 1, 0.0, 0.0, 9.0, 9.0, 0.9), ("a", 0, 2, 0.0, 0.0, 9.0, 3.0, 0.8), ("a", 0, 3, 0.0, 0.0, 9.0, 8.0, 0.8), ("b", 0, 4, 5.0, 5.0, 1.0, 1.0, 0.1)], "media_id string, frame_idx int, id int, x double, y double, w double, h double, det_score double")
    assert values(boxes.nms(b), "id") == [(1,), (2,), (4,)]  # IoU of exactly 0.4 stays
    assert values(boxes.nms(b.limit(0)), "id") == []


def test_lines(spark):
    w = spark.createDataFrame([("a", 0, i, t, x, 0.0, 50.0, 20.0) for i, (t, x) in enumerate([("one", 0.0), ("two", 150.0), ("far", 301.0)])], "media_id string, frame_idx int, id int, text string, x double, y double, w double, h double")
    assert [r[0] for r in values(boxes.merge_lines(w), "text")] == ["far", "one two"]
    assert values(boxes.merge_lines(w.limit(1)), "text", "w") == [("one", 50.0)]


def test_a_line_takes_the_next_free_word(spark):
    w = spark.createDataFrame([("m", 0, 1, "A", 0.0, 0.0, 10.0, 10.0), ("m", 0, 2, "B", 1.0, 8.0, 19.0, 10.0), ("m", 0, 3, "C", 25.0, 4.0, 15.0, 10.0)], "media_id string, frame_idx int, id int, text string, x double, y double, w double, h double")
    assert values(boxes.merge_lines(w, y_gap=-7), "text") == [("A C",), ("B",)]
    far = w.withColumn("x", F.when(F.col("text") == "C", 200.0).otherwise(F.col("x")))
    assert values(boxes.merge_lines(far, y_gap=-7), "text") == [("A",), ("B",), ("C",)]


def test_face_size_filter_keeps_whole_faces(spark):
    b = spark.createDataFrame([(1, "f", 0.2), (2, "f", 0.01), (3, "g", 0.05)], "id int, ref_id string, h double")
    faces = spark.createDataFrame([("f",), ("g",)], "id string")
    out = boxes.face_size_filter(b, faces)
    assert values(out["boxes"], "id") == [(1,), (2,)] and values(out["faces"], "id") == [("f",)] and set(out) == {"boxes", "faces"}


def test_dominant_colours(spark):
    px = spark.createDataFrame([("a", 0, 255, 0, 0)] * 3 + [("a", 0, 0, 0, 255)] * 2 + [("a", 0, 254, 0, 0)], "media_id string, frame_idx int, r int, g int, b int")
    two = [tuple(r) for r in frames.dominant_colors(px, k=2).orderBy("rank").select("r", "b").collect()]
    assert two[0] == (0.0, 1.0) and two[1][0] > 0.99


def test_centres_of_many_frames_at_once():
    rng = np.random.default_rng(0)
    found = []
    for _ in range(60):  # few values, so that ties are many
        distinct = {tuple(c): int(rng.integers(1, 4)) for c in rng.integers(0, 5, (int(rng.integers(1, 9)), 3))}
        found.append(sorted((-n, *c) for c, n in distinct.items()))
    x = np.array([p[1:] for f in found for p in f], float)
    n = np.array([-p[0] for f in found for p in f], float)
    offsets = np.cumsum([0, *map(len, found)])
    k = 3
    frame, rank, colours = frames._centres(x, n, offsets, k, 10)
    for i, f in enumerate(found):
        far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
        pixels = [(tuple(map(float, p[1:])), -p[0]) for p in f]
        c = [pixels[0][0]]
        while len(c) < min(k, len(pixels)):
            c.append(max(pixels, key=lambda p: p[1] * min(far(p[0], y) for y in c))[0])
        nearest = lambda p: min(range(len(c)), key=lambda j: far(p, c[j]))
        for _ in range(10):
            own = [[q for q in pixels if nearest(q[0]) == j] for j in range(len(c))]
            c = [tuple(sum(m * v[a] for v, m in o) / sum(m for _, m in o) for a in range(3)) if o else c[j] for j, o in enumerate(own)]
        want = sorted((sum(m for v, m in pixels if nearest(v) == j), *c[j]) for j in range(len(c)))
        got = [tuple(y) for y in colours[frame == i]]
        assert np.allclose(got, [w[1:] for w in want]) and rank[frame == i].tolist() == list(range(len(c)))


def test_audio(spark):
    n = 2048
    y = [math.sin(2 * math.pi * 1000 * i / 8000) for i in range(n)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(y)], "media_id string, i long, y double")
    rms = [r.y for r in audio.audio_rms(df, normalize=False, hop=512, frame=1024).orderBy("k").collect()]
    padded = np.concatenate([np.zeros(512), y, np.zeros(512)])
    want = [np.sqrt((padded[512 * k : 512 * k + 1024] ** 2).sum() / 1024) for k in range(n // 512 + 1)]
    assert np.allclose(rms, want)
    freq = audio.audio_freq(df, normalize=False).groupBy("bin").agg(F.avg("value").alias("v")).orderBy(F.desc("v")).first()
    assert freq.bin == 32  # 1000 Hz of 8000 in 256
    amp = [r.y for r in audio.audio_amp(df, max_samples=100, normalize=False).orderBy("time").collect()]
    assert np.allclose(amp, np.interp(np.linspace(0, n - 1, 100), np.arange(n), y))


def test_chunks_round_trip(spark):
    df = spark.createDataFrame([(1, bytearray(range(250))), (2, bytearray()), (3, bytearray(b"abcd"))], "id int, data binary")
    chunks = ingest.dump_chunks(df, size=4).orderBy(F.rand(1))
    assert {(r.id, bytes(r.data)) for r in ingest.reassemble(chunks).collect()} == {(1, bytes(range(250))), (3, b"abcd")}


def test_ingest_dedup_is_idempotent(spark):
    new = ingest.with_sha1(spark.createDataFrame([("n1", 1, "x"), ("n2", 2, "x"), ("n3", 3, "z"), ("n4", 4, "old")], "media_id string, ingest_seq int, content string"))
    have = ingest.with_sha1(spark.createDataFrame([("o", "old")], "media_id string, content string"))
    kept, mapping = ingest.dedup_ingest(new, have)
    assert values(kept, "media_id") == [("n1",), ("n3",)]
    assert values(mapping, "new_id", "canonical_id") == [("n1", "n1"), ("n2", "n1"), ("n3", "n3"), ("n4", "o")]
    again, _ = ingest.dedup_ingest(new, have.select("media_id", "sha1").unionByName(kept.select("media_id", "sha1")))
    assert again.count() == 0


def test_packets_and_tables(spark, tmp_path):
    p = spark.createDataFrame([("abcd1", "series", 1), ("abce2", "shots", 2)], "id string, type string, v int")
    ingest.write_packets(p, str(tmp_path / "p"))
    assert values(ingest.load_packets(spark, str(tmp_path / "p"), "series", ["abcd1"]), "v") == [(1,)]
    with pytest.raises(ValueError):
        ingest.load_packets(spark, str(tmp_path / "p"), "nothing")
    s = spark.createDataFrame([("a", 0, 0.0, 1.0)], "media_id string, shot_idx int, start_s double, end_s double")
    ingest.write_table(s, str(tmp_path / "s"), "shots")
    assert ingest.read_table(spark, str(tmp_path / "s"), "shots").count() == 1
    with pytest.raises(SchemaMismatch):
        conform(s.drop("end_s"), "shots")
    with pytest.raises(ValueError):
        ingest.check_blobs(p, p.limit(1))
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "clip.MP4").write_bytes(b"12")
    r = ingest.read_media(spark, str(tmp_path / "m")).first()
    assert (r.kind, r.ext, bytes(r.content)) == ("video", "mp4", b"12")


def test_text_functions(spark):
    df = spark.createDataFrame([("MyHTTPServer", "a" * 32, "A&amp;amp;B  \n c")], "n string, i string, t string")
    r = df.select(X.snake_case(F.col("n")).alias("n"), X.valid_id(F.col("i")).alias("i"), X.valid_id(F.concat("i", F.lit("\n"))).alias("j"), X.clean_text(F.col("t")).alias("t")).first()
    assert (r.n, r.i, r.j, r.t) == ("my_http_server", True, False, "a&b c")
    t = spark.createDataFrame([("caf&eacute; &#233;&#xE9;&nbsp;\u00a0 &unknown; &amp;lt; &#128512; &#55296; &amp;#38;amp; &",), (None,), ("",)], "t string")
    assert [r[0] for r in t.select(X.clean_text(F.col("t"))).collect()] == ["caf\u00e9 \u00e9\u00e9 &unknown; < \U0001f600 \ufffd &amp; &", None, ""]
    some = [("&#x26;lt; &#038;lt; &lt &copy 2020 &notit; &notin; &NotEqual; &#0; &#x80; &amp;amp;lt",), ("&ampamp; &acirc;&Acirc &zwnj &gt;&gt &#62 &#x3e &; &#; &#x; &&lt",), ("plain",)]
    once = [r[0] for r in spark.createDataFrame(some, "t string").select(X.unescape_html(F.col("t"))).collect()]
    assert once == ["&lt; &lt; < \u00a9 2020 \u00acit; \u2209 \u2260 \ufffd \u20ac &amp;lt", "&amp; \u00e2\u00c2 &zwnj >> > > &; &#; &#x; &<", "plain"]
    p = spark.createDataFrame([("BOOL", "False"), ("BOOL", "false"), ("INT", "x"), ("FLOAT", "1.5")], "k string, v string")
    got = [tuple(r.c) for r in p.select(X.cast_parameter(F.col("k"), F.col("v")).alias("c")).collect()]
    assert got == [(None, None, None, False), (None, None, None, True), (None, None, None, None), (None, None, 1.5, None)]
    j = spark.createDataFrame([('{"a": [{"b": 7}]}',)], "j string")
    assert tuple(j.select(X.look_up(F.col("j"), "a.0.b"), X.look_up(F.col("j"), "a.5.b")).first()) == ("7", None)
    t = spark.createDataFrame([([1, 2, 3, 4],), ([1],)], "t array<int>")
    assert [r[0] for r in t.select(X.fit_context(F.col("t"), 3)).collect()] == [[1, 2, 4], [1, 0, 0]]


def test_registry(spark):
    import lumenspan.plans.registered  # noqa: F401

    df = spark.createDataFrame([("a", "x", 0.0, 1.0), ("a", "x", 1.0, 3.0)], S)
    names = [o.name for o in registry.list_operators()]
    assert names == sorted(names) and len(names) >= 35 and "min_max_norm" in names
    emb = spark.createDataFrame([("a", i, i, [1.0, float(i % 2)]) for i in range(4)], "media_id string, id long, ref_id long, embedding array<double>")
    assert registry.run("clustering", {"embeddings": emb}, {"t": 0.1})["clusters"].select("cluster_id").distinct().count() == 2
    faces = spark.createDataFrame([("f",)], "id string")
    b = spark.createDataFrame([("a", 1, "f", 0.0, 0.0, 0.2, 0.2)], "media_id string, id int, ref_id string, x double, y double, w double, h double")
    assert set(registry.run("face_size_filter", {"boxes": b, "faces": faces.withColumns({"media_id": F.lit("a"), "ref_id": F.lit("i")})})) == {"boxes", "faces"}
    words = spark.createDataFrame([("a", 0, 1, "x", 0.0, 0.0, 5.0, 5.0, 0.9)], "media_id string, frame_idx int, id int, text string, x double, y double, w double, h double, det_score double")
    assert registry.run("ocr_video_detector_onnx", {"words": words})["lines"].first().text == "x"
    with pytest.raises(KeyError):
        registry.run("nothing", {})
    assert values(registry.run("min_max_norm", {"series": df}, {"eps": 5})["series"], "y") == [(1.0,), (3.0,)]
    assert values(registry.run("min_max_norm", {"series": df})["series"], "y") == [(0.0,), (1.0,)]  # parameters don't leak
    with pytest.raises(SchemaMismatch):
        registry.run("min_max_norm", {"series": df.drop("y")})
    with pytest.raises(TypeError):
        registry.run("min_max_norm", {"series": df}, {"nothing": 1})


def test_of_new_rows_with_one_id_one_gets_in(spark):
    new = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c"), (None, "d"), (None, "d"), (3, "old")], "id long, v string")
    table, conflicts = ingest.insert_if_absent(new, spark.createDataFrame([(3, "was")], "id long, v string"))
    got = table.collect()
    assert sorted(r.id for r in got if r.id) == [1, 2, 3] and sum(r.id is None for r in got) == 2
    assert sorted(map(str, [*got, *conflicts.collect()])) == sorted(map(str, [*new.collect(), *spark.createDataFrame([(3, "was")], "id long, v string").collect()]))


def test_infer_loads_once_for_a_task(spark):
    def load():
        return lambda f: pd.DataFrame({"twice": f.id * 2})

    assert values(infer(spark.range(100), load, ["id"], "twice long", keep=["id"]), "twice")[-1] == (198,)


def test_streams(spark, tmp_path):
    schema = "media_id string, ingest_seq int, content string, ts timestamp"
    src = tmp_path / "in"
    rows = lambda r: spark.createDataFrame(r, "media_id string, ingest_seq int, content string").withColumn("ts", F.current_timestamp())
    rows([("a", 1, "x"), ("b", 2, "x")]).write.parquet(str(src / "1"))
    start = lambda: ingest_stream(spark.readStream.schema(schema).parquet(str(src / "*")), str(tmp_path / "store"), str(tmp_path / "map"), str(tmp_path / "cp")).awaitTermination()
    start()
    rows([("c", 3, "x"), ("d", 4, "z")]).write.parquet(str(src / "2"))
    start()
    assert values(spark.read.parquet(str(tmp_path / "store")), "media_id") == [("a",), ("d",)]
    assert ("c", "a") in values(spark.read.parquet(str(tmp_path / "map")), "new_id", "canonical_id")
    q = dedup_within(spark.readStream.schema(schema).parquet(str(src / "*")), "ts").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 2


def folders(path):
    """Names and times of the files of a table."""
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_ingest_reads_touched_buckets(spark, tmp_path):
    rows = lambda r: spark.createDataFrame(r, "media_id string, ingest_seq int, content string")
    store, mapping = tmp_path / "store", str(tmp_path / "map")
    first = rows([(f"a{i}", i, f"text {i % 90}") for i in range(120)] + [("n", 1, None), ("m", 2, None)])
    merge_batch(first, 0, str(store), mapping)
    assert len(values(spark.read.parquet(str(store)), "media_id")) == 92
    second = rows([("b1", 1, "text 7"), ("b2", 2, "new"), ("b3", 3, "new")])
    touched = {h[0][:2] for h in values(with_sha1(second, "content"), "sha1")}
    listed = stored_hashes(spark, str(store), sorted(touched)).inputFiles()
    assert listed and {f.split("prefix=")[1][:2] for f in listed} <= touched
    assert stored_hashes(spark, str(store), ["zz"]) is None and stored_hashes(spark, str(tmp_path / "no"), ["00"]) is None
    for _ in range(2):  # again, as after a failure
        merge_batch(second, 1, str(store), mapping)
        assert len(values(spark.read.parquet(str(store)), "media_id")) == 93
        assert values(spark.read.parquet(mapping + "/batch=1"), "new_id", "canonical_id") == [("b1", "a7"), ("b2", "b2"), ("b3", "b2")]
    before = folders(store)
    merge_batch(second.limit(0), 2, str(store), mapping)
    assert folders(store) == before


def test_stored_delete_leaves_other_shards(spark, tmp_path):
    path = tmp_path / "packets"
    packets = spark.createDataFrame([(f"{a}{b}{i}", kind, f"n{i}") for a in ("00", "11", "ab") for b in ("22", "cd") for i in range(3) for kind in ("shots", "series")], "id string, type string, name string")
    ingest.write_packets(packets, str(path))
    before = folders(path)
    gone = spark.createDataFrame([("00221",), ("abcd0",), ("abcd1",), ("abcd2",), ("9999x",), ("1122x",), (None,)], "id string")
    for _ in range(2):  # again changes nothing more
        ingest.delete_packets(spark, str(path), gone)
        left = {r.id for kind in ("shots", "series") for r in ingest.load_packets(spark, str(path), kind).collect()}
        assert left == {r.id for r in packets.collect()} - {"00221", "abcd0", "abcd1", "abcd2"}
        touched = ("shard1=00/shard2=22", "shard1=ab/shard2=cd")
        assert {f: t for f, t in folders(path).items() if not any(x in f for x in touched)} == {f: t for f, t in before.items() if not any(x in f for x in touched)}
    assert not any(f in folders(path) for f in before if "shard1=00/shard2=22" in f)
    # an emptied shard takes packets again
    ingest.write_packets(spark.createDataFrame([("abcd1", "shots", "back")], "id string, type string, name string"), str(path))
    assert values(ingest.load_packets(spark, str(path), "shots", ["abcd1", "abcd2", "00220"]), "id", "name") == [("00220", "n0"), ("abcd1", "back")]
    assert len(values(ingest.load_packets(spark, str(path), "shots"), "id")) == 15


def test_chunks_over_batches_and_restarts(spark, tmp_path):
    src, schema = tmp_path / "c", "id string, seq int, last boolean, data string"
    put = lambda r, n: spark.createDataFrame(r, schema).coalesce(1).write.parquet(str(src / n))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    go = lambda: reassemble_stream(stream(), str(tmp_path / "whole"), str(tmp_path / "cp2")).awaitTermination()
    done = lambda: values(spark.read.parquet(str(tmp_path / "whole")), "id", "data", "complete")
    put([("v", 1, True, "b"), ("w", 0, True, "w"), (None, 0, True, "lost"), ("x", None, True, "lost"), ("u", 2, False, "2")], "1")
    go()
    assert done() == [("w", "w", True)]
    put([("v", 0, False, "a"), ("v", 1, True, "b"), ("w", 0, True, "again"), ("u", 0, None, "0")], "2")
    put([("v", 0, False, "late"), ("u", 2, False, "twice"), ("u", 3, True, "3")], "3")
    go()
    assert done() == [("v", "ab", True), ("w", "w", True)]
    put([("u", 1, False, "1")], "4")
    go()
    assert done() == [("u", "0123", True), ("v", "ab", True), ("w", "w", True)]


def test_chunks_that_never_end(spark, tmp_path):
    src, schema = tmp_path / "c", "id long, seq int, last boolean, data binary, at timestamp"
    stamp = lambda m: datetime.datetime(2024, 1, 1, m // 60, m % 60)
    put = lambda r, n: spark.createDataFrame([(*x[:4], stamp(x[4])) for x in r], schema).coalesce(1).write.parquet(str(src / n))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    go = lambda: reassemble_stream(stream(), str(tmp_path / "whole"), str(tmp_path / "cp"), "at", "90 minutes").awaitTermination()
    put([(1, 0, False, b"a", 0), (2, 0, False, b"x", 0), (3, 0, True, b"z", 0)], "1")
    put([(1, 1, True, b"b", 60), (2, 1, False, b"y", 80)], "2")
    put([(9, 0, True, b"", 100)], "3")  # 2 waits on, as its newest chunk is of minute 80
    go()
    done = lambda: sorted((r.id, r.data and bytes(r.data), r.complete) for r in spark.read.parquet(str(tmp_path / "whole")).collect())
    assert done() == [(1, b"ab", True), (3, b"z", True), (9, b"", True)]
    put([(8, 0, False, b"q", 300)], "4")
    put([(7, 0, True, b"r", 301)], "5")
    go()
    assert (2, None, False) in done() and len(done()) == 5


def test_joins_of_crowded_keys(spark):
    left = spark.createDataFrame([(1, i) for i in range(3_000)] + [(k, 0) for k in range(2, 40)] + [(99, 1)], "k long, v long")
    sizes = left.where("k < 99").groupBy("k").agg(F.count("*").alias("n"))
    got = join_counted(left, sizes, ["k"], left.count())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(sizes, "k").collect()))
