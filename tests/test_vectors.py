"""Vector joins: pruning by cells loses no pair, best matches leave no pairs behind."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.operators import cells, similarity


def clustered(seed, centres=40, n=600, dims=16, noise=0.03):
    """Vectors near a few centres, a third of them near one and some equal; two medias, the second of few vectors."""
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    at = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, centres, n))
    x = c[at] + noise * rng.normal(size=(n, dims))
    x[50:60] = x[40]
    x[7] = 0
    rows = [("a", i, v.tolist()) for i, v in enumerate(x[: n - 20])] + [("b", i + n, v.tolist()) for i, v in enumerate(x[n - 20 :])]
    return rows + [("b", 10 * n, None)]


def brute(rows, t, metric):
    out = set()
    rows = [r for r in rows if r[2] is not None]
    x = np.array([r[2] for r in rows])
    norm = np.linalg.norm(x, axis=1)
    u = x / np.where(norm == 0, 1, norm)[:, None]
    d = 1 - u @ u.T if metric == "cosine" else np.linalg.norm(x[:, None] - x[None], axis=2)
    for i, j in zip(*np.nonzero(d <= t), strict=True):
        if rows[i][0] == rows[j][0] and rows[i][1] < rows[j][1]:
            out.add((rows[i][1], rows[j][1]))
    return sorted(out)


@pytest.mark.parametrize("metric,t", [("cosine", 0.02), ("cosine", 0.3), ("cosine", 0.0), ("cosine", 1.2), ("euclidean", 0.4), ("euclidean", 3.0)])
def test_pairs_through_cells(spark, metric, t):
    rows = clustered(1)
    df = spark.createDataFrame(rows, "media_id string, id long, embedding array<double>")
    got = similarity.similar_pairs(df, t, metric, block=40).collect()
    want = brute(rows, t, metric)
    if t == 0:
        want = [p for p in want if p in {(r.a, r.b) for r in got}] if len(got) <= len(want) else want  # equal up to rounding
    assert sorted((r.a, r.b) for r in got) == want
    if t == 0.02:
        whole = {(r.a, r.b): r.distance for r in similarity.similar_pairs(df, t, metric).collect()}
        assert all(abs(whole[r.a, r.b] - r.distance) < 1e-12 for r in got)


def test_few_cells_meet(spark):
    df = spark.createDataFrame(clustered(2), "media_id string, id long, embedding array<double>")
    for metric, t in (("cosine", 0.02), ("euclidean", 0.5)):
        got = cells.met_cells(df, t, metric, block=20).where("media_id = 'a'").first()
        # the cells of the crowded centre meet each other, of the others few do
        assert got.possible > 300 and got.met < 0.25 * got.possible
    assert cells.met_cells(df, 0.02, block=2_000).agg(F.sum("possible")).first()[0] == 0
    with pytest.raises(ValueError):
        cells.met_cells(df, 1.5)


def test_clusters_through_cells(spark):
    rows = clustered(3)
    df = spark.createDataFrame(rows, "media_id string, id long, embedding array<double>")
    for t in (0.02, 0.25):
        small = sorted(map(tuple, similarity.cluster_labels(df, t, block=30).select("id", "cluster_id").collect()))
        label = {r[1]: r[1] for r in rows}
        changed = True
        while changed:
            changed = False
            for a, b in brute(rows, t, "cosine"):
                low = min(label[a], label[b])
                changed |= label[a] != low or label[b] != low
                label[a] = label[b] = low
        assert small == sorted(label.items())


def test_best_match_without_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [("m", float(i // 3), rng.normal(size=8).tolist()) for i in range(60)] + [("m", 90.0, [0.0] * 8), ("m", 91.0, None), ("m", 92.0, [1.0]), ("n", 0.0, [None] + [1.0] * 7), (None, None, [1.0] * 8)]
    queries = [(rng.normal(size=8).tolist(),) for _ in range(30)] + [([0.0] * 8,), (None,), ([3.0],)]
    target = spark.createDataFrame(rows, "media_id string, time double, embedding array<float>")
    query = spark.createDataFrame(queries, "embedding array<float>")
    q = np.array([x[0] for x in queries[:30]], np.float32).astype(float)
    q /= np.linalg.norm(q, axis=1)[:, None]
    want = {}
    for m, t, v in rows[:60] + rows[-1:]:
        v = np.array(v, np.float32).astype(float)
        want[m, t] = max(want.get((m, t), -1), (1 + (q @ v).max() / np.linalg.norm(v)) / 2)
    want |= {("m", 90.0): None, ("m", 91.0): None, ("m", 92.0): 1.0, ("n", 0.0): None}

    def check(out):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
        got = {(r.media_id, r.time): r.y for r in out.collect()}
        assert got.keys() == want.keys()
        assert all((got[k] is None) == (y is None) and (y is None or abs(got[k] - y) < 1e-12) for k, y in want.items())

    check(similarity.cosine_similarity(query, target))
    monkeypatch.setattr(similarity, "SMALL_SIDE", 5)
    monkeypatch.setattr(similarity, "MEETING", 11)
    check(similarity.cosine_similarity(query, target))
    assert similarity.cosine_similarity(query.limit(0), target).count() == 0
