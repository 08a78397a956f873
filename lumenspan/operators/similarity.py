"""Embeddings: cosine scores, concept probabilities, threshold graphs and their clusters."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2_normalise, mean_vector, norm
from .cells import matrix, meetings, unit
from .graph import components, spanning_forest
from .series import rescale
from .skew import dealt
from .windows import even_sample

#: Rows of a block of the similarity self-join.
BLOCK = 4_096
#: A query or concept table of up to so many rows and components is broadcast; beyond that both sides are dealt in blocks.
SMALL_SIDE, SMALL_COMPONENTS = 2_000, 4_000_000
#: Rows of each side of a meeting of queries and targets, and targets of one product of matrices.
MEETING, STEP = 16_384, 1_024
#: Logits of one product of a task, and of a task, of concept probabilities.
MEETING_ROWS, TASK_LOGITS = 262_144, 8_000_000


def _all_with(targets: DataFrame, few: DataFrame) -> DataFrame:
    """Every target with every row of the stated table, which is broadcast if counted small, else met block by block."""
    vectors = [c for c, kind in few.dtypes if kind.startswith("array")]
    rows, components_ = few.agg(F.count("*"), F.coalesce(F.sum(sum((F.coalesce(F.size(c), F.lit(0)) for c in vectors), F.lit(0))), F.lit(0))).first()
    if rows <= SMALL_SIDE and components_ <= SMALL_COMPONENTS:
        return targets.crossJoin(F.broadcast(few))
    n = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = targets.withColumn("_b", F.pmod(F.xxhash64(*targets.columns), F.lit(n)))
    return dealt.join(few.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))), "_b").drop("_b")


def _best(targets: pa.Table, queries: dict[int, np.ndarray]) -> pa.Array:
    """The best cosine of each target with any query of its length; null for zero vectors, holes, and lengths without a query."""
    vectors = targets.column("_t").combine_chunks()
    best = np.full(len(vectors), np.nan)
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for n in np.unique(size[size > 0]).tolist():
        if n in queries:
            at = np.flatnonzero(size == n)
            x = matrix(vectors.take(pa.array(at)))  # holes become NaN
            x[~np.isfinite(x).all(1) | ~x.any(1)] = np.nan
            for first in range(0, len(at), STEP):
                best[at[first : first + STEP]] = (unit(x[first : first + STEP]) @ queries[n].T).max(1)
    return pa.array(best, from_pandas=True)


def _by_length(vectors: pa.ChunkedArray) -> dict[int, np.ndarray]:
    """Unit vectors by length; zero vectors and such with holes are near to nothing."""
    vectors = vectors.combine_chunks()
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(size[size > 0]).tolist():
        x = matrix(vectors.take(pa.array(np.flatnonzero(size == n))))
        x = x[np.isfinite(x).all(1) & x.any(1)]
        if len(x):
            out[n] = unit(x)
    return out


def cosine_similarity(query: DataFrame, target: DataFrame, normalize: bool = False, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """(media_id, time, y): the best (1 + cos) / 2 of any query vector with any target of a time, rescaled if asked.

    Targets meet the queries as products of matrices, and only each target's best leaves a task. Queries that were
    counted small are sent to all tasks; otherwise both sides are dealt in blocks that meet once.
    """
    kinds = dict(target.dtypes)
    schema = f"media_id {kinds['media_id']}, time {kinds['time']}, y double"
    rows = target.select("media_id", "time", F.col("embedding").alias("_t"))
    few = query.select(F.col("embedding").alias("_q"))
    n, components_ = few.agg(F.count("*"), F.coalesce(F.sum(F.coalesce(F.size("_q"), F.lit(0))), F.lit(0))).first()
    names = ["media_id", "time", "y"]
    if not n:
        return target.select("media_id", "time", F.lit(None).cast("double").alias("y")).limit(0)
    if n <= SMALL_SIDE and components_ <= SMALL_COMPONENTS:
        sent = target.sparkSession.sparkContext.broadcast(_by_length(few.toArrow().column("_q")))

        def meet(batches):
            for b in batches:
                t = pa.Table.from_batches([b])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _best(t, sent.value)], names)

        met = rows.mapInArrow(meet, schema)
    else:
        a, b = (max(1, math.ceil(x / MEETING)) for x in (n, rows.count()))
        each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        dealt = lambda df, k: F.pmod(F.xxhash64(*df.columns), F.lit(k)).cast("int")
        left = rows.withColumn("_b", dealt(rows, b)).withColumn("_a", each(a)).groupBy("_a", "_b")
        right = few.withColumn("_a", dealt(few, a)).withColumn("_b", each(b)).groupBy("_a", "_b")
        meet_blocks = lambda t, q: pa.table([t.column("media_id"), t.column("time"), _best(t, _by_length(q.column("_q")))], names)
        met = left.cogroup(right).applyInArrow(meet_blocks, schema)
    best = met.groupBy("media_id", "time").agg(F.max((1 + F.col("y")) / 2).alias("y"))
    return rescale(best, lo, hi, keys=("media_id",), normalize=normalize)


def mean_embedding(emb: DataFrame, by: str) -> DataFrame:
    """(by, embedding): the normalised mean of the normalised vectors of each group, summed by component."""
    return mean_vector(emb.withColumn("embedding", l2_normalise(F.col("embedding"))), by).withColumn("embedding", l2_normalise(F.col("embedding")))


def text_image_probs(images: DataFrame, positive: DataFrame, negative: DataFrame, softmax: bool = False, scale: float = 100.0) -> DataFrame:
    """(media_id, id, time, y): each image against one positive and one negative text vector (tables of one row)."""
    if positive.limit(2).count() > 1 or negative.limit(2).count() > 1:
        raise ValueError("positive and negative have one row each")
    pair = positive.select(F.col("embedding").alias("_p")).crossJoin(F.broadcast(negative.select(F.col("embedding").alias("_n"))))
    v = l2_normalise(F.col("embedding"))
    met = images.crossJoin(F.broadcast(pair)).withColumns({"_dp": dot(v, l2_normalise(F.col("_p"))), "_dn": dot(v, l2_normalise(F.col("_n")))})
    y = 1 / (1 + F.exp(scale * (F.col("_dn") - F.col("_dp")))) if softmax else F.col("_dp")
    return met.select("media_id", "id", "time", y.alias("y"))


def _logits(vectors: pa.Array, concepts: dict[int, tuple[np.ndarray, np.ndarray]], k: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """scale * dot of each vector with each of the k concepts, and whether there is one: both have to be of one length."""
    z, known = np.zeros((len(vectors), k)), np.zeros((len(vectors), k), bool)
    size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    for n in set(size.tolist()) & set(concepts):
        at, (places, x) = np.flatnonzero(size == n), concepts[n]
        part = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)
        z[np.ix_(at, places)] = scale * (part @ x.T)
        known[np.ix_(at, places)] = True
    return z, known


def ontology_probs(emb: DataFrame, concepts: DataFrame, scale: float = 100.0) -> DataFrame:
    """(media_id, id, concept, y): softmax over all concepts of scale * dot; concepts: (concept, embedding).

    Concepts of up to SMALL_COMPONENTS are sent to all tasks and met as products of matrices: once for each vector's
    largest logit and sum, which are put together where an id of a media occurs repeatedly, and once for the shares.
    Only vectors are shuffled. Beyond that each logit is a row.
    """
    vectors = emb.select("media_id", "id", l2_normalise(F.col("embedding")).alias("_v"))
    stated = concepts.select("concept", l2_normalise(F.col("embedding")).alias("_c"))
    k, components_ = stated.agg(F.count("*"), F.coalesce(F.sum(F.coalesce(F.size("_c"), F.lit(0))), F.lit(0))).first()
    w = Window.partitionBy("media_id", "id")
    if max(k, components_) > SMALL_COMPONENTS:
        logits = _all_with(vectors, stated).select("media_id", "id", "concept", (scale * dot(F.col("_v"), F.col("_c"))).alias("z"))
        e = logits.withColumn("e", F.exp(F.col("z") - F.max("z").over(w)))
        return e.select("media_id", "id", "concept", (F.col("e") / F.sum("e").over(w)).alias("y"))
    few, by_length = stated.toArrow().combine_chunks(), {}
    c = few.column("_c").combine_chunks()
    size = pc.fill_null(pc.list_value_length(c), -1).to_numpy(zero_copy_only=False)
    for n in set(size[size >= 0].tolist()):
        places = np.flatnonzero(size == n)
        by_length[n] = places, c.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).reshape(len(places), n)
    sent = emb.sparkSession.sparkContext.broadcast((few.column("concept").combine_chunks(), by_length))
    step = max(1, MEETING_ROWS // max(1, k))

    def pieces(batches):
        for b in batches:
            for first in range(0, b.num_rows, step):
                part = b.slice(first, step)
                yield part, *_logits(part.column(2), sent.value[1], k, scale)

    def sums(batches):
        for part, z, known in pieces(batches):
            some = known.any(1)
            top = np.where(known, z, -np.inf).max(1, initial=-np.inf)
            with np.errstate(invalid="ignore"):
                total = np.where(known, np.exp(z - top[:, None]), 0).sum(1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(top, mask=~some), pa.array(total, mask=~some)], ["media_id", "id", "_v", "_top", "_sum"])

    def shares(batches):
        names = sent.value[0]
        for part, z, known in pieces(batches):
            top, total = (part.column(i).to_numpy(zero_copy_only=False)[:, None] for i in (3, 4))
            with np.errstate(invalid="ignore"):
                y = np.exp(z - top) / total
            row = pa.array(np.repeat(np.arange(part.num_rows), k))
            concept = names.take(pa.array(np.tile(np.arange(k), part.num_rows)))
            yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), concept, pa.array(y.ravel(), mask=~known.ravel())], ["media_id", "id", "concept", "y"])

    kinds, name = dict(vectors.dtypes), dict(stated.dtypes)["concept"]
    own = f"media_id {kinds['media_id']}, id {kinds['id']}"
    held = vectors.mapInArrow(sums, f"{own}, _v array<double>, _top double, _sum double")
    held = dealt(held, ["media_id", "id"], emb.count() * k, TASK_LOGITS).withColumn("_all", F.max("_top").over(w))
    held = held.select("media_id", "id", "_v", F.col("_all").alias("_top"), F.sum(F.col("_sum") * F.exp(F.col("_top") - F.col("_all"))).over(w).alias("_sum"))
    return held.mapInArrow(shares, f"{own}, concept {name}, y double")


def similar_pairs(emb: DataFrame, t: float, metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """(a, b, distance) of all pairs a < b of one media with distance <= t; emb: (media_id, id, embedding).

    A media of more than `block` vectors is cut into cells, of which those meet that can hold a pair within t (see
    cells); a meeting is a product of matrices in a task, and only pairs within t leave it.
    """
    kind = dict(emb.dtypes)["id"]
    return meetings(emb, t, metric, block, _pairs(t, metric, False), f"a {kind}, b {kind}, distance double")


def _pairs(t: float, metric: str, forest: bool):
    """The pairs within t of two blocks; forest: only enough of them to connect what they connect."""

    def find(rows: pa.Table, same: bool) -> pa.Table:
        ids = rows.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x, first = ids[order], matrix(rows.column("embedding"))[order], rows.column("first").to_numpy()[order]
        left, right = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(first), np.flatnonzero(~first))
        if metric == "cosine":
            u = unit(x)
            d = 1 - u[left] @ u[right].T
        else:
            sq = (x**2).sum(1)
            d = np.sqrt(np.maximum(sq[left, None] + sq[None, right] - 2 * x[left] @ x[right].T, 0))
        i, j = np.nonzero(d <= t)
        if forest:
            moved, to = spanning_forest(left[i], right[j], len(ids))
            a, b, distance = ids[moved], ids[to], np.zeros(len(moved))
        else:
            a, b, distance = ids[left[i]], ids[right[j]], d[i, j]
            keep = a < b if same else a != b
            a, b, distance = a[keep], b[keep], distance[keep]
        kind = rows.schema.field("id").type
        lo, hi = (np.where(a < b, a, b), np.where(a < b, b, a)) if len(a) else (a, b)
        return pa.table({"a": pa.array(lo, kind), "b": pa.array(hi, kind), "distance": pa.array(distance, pa.float64())})

    return find


def cluster_labels(emb: DataFrame, t: float = 0.5, metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """(media_id, id, cluster_id): single linkage cut at t, which is the components of pairs within t; cluster_id is the smallest member.

    Equal vectors of a media are one from the start (but for zero vectors and cosine, as they are near to nothing),
    and each meeting of two blocks gives a spanning forest of its pairs, so a large group of copies or of near
    vectors never becomes all of its pairs.
    """
    kind = dict(emb.dtypes)["id"]
    zero = F.lit(metric == "cosine") & (norm(F.col("embedding")) == 0)
    some = emb.where("embedding is not null").select("media_id", "id", "embedding", F.when(zero, F.col("id")).alias("_own"))
    first = some.groupBy("media_id", "embedding", "_own").agg(F.min("id").alias("id"))
    same = some.where("_own is null").join(first.where("_own is null").select("media_id", "embedding", F.col("id").alias("_first")), ["media_id", "embedding"]).where("id <> _first")
    found = components(meetings(first.select("media_id", "id", "embedding"), t, metric, block, _pairs(t, metric, True), f"a {kind}, b {kind}, distance double").select("a", "b").unionByName(same.select(F.col("_first").alias("a"), F.col("id").alias("b"))))
    return emb.join(found, emb["id"] == found["node"], "left").select("media_id", "id", F.coalesce("label", "id").alias("cluster_id"))


def build_clusters(labels: DataFrame, members: DataFrame, max_samples: int = 30) -> DataFrame:
    """(media_id, cluster_id, member_id, member_ref_id, is_sample, size, rank): members with an even sample of
    each cluster; rank orders a media's clusters by size, then by first member."""
    joined = labels.join(members.select("id", "ref_id"), "id").select("media_id", "cluster_id", F.col("id").alias("member_id"), F.col("ref_id").alias("member_ref_id"))
    sampled = even_sample(joined, ("media_id", "cluster_id"), ("member_id",), max_samples)
    sizes = joined.groupBy("media_id", "cluster_id").agg(F.count("*").alias("size"), F.min("member_id").alias("_f"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("size"), "_f"))).drop("_f")
    return sampled.join(ranked, ["media_id", "cluster_id"])


def top_clusters(clusters: DataFrame, k: int = 50) -> DataFrame:
    """The k largest clusters of each media."""
    return clusters.where(F.col("rank") <= k)


def place_clusters(emb: DataFrame, places: DataFrame, t: float = 0.25, max_samples: int = 30) -> DataFrame:
    """Clusters of place embeddings, whose members carry their places (level, class, prob)."""
    built = build_clusters(cluster_labels(emb, t), emb.select("id", "ref_id"), max_samples)
    return built.join(places.select(F.col("id").alias("member_id"), "level", "class", "prob"), "member_id", "left")


def places_rollup(probs: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(media_id, id, level, class, prob, is_best): class probabilities, and their sums by parent weighted by membership.

    probs: (media_id, id, class, prob); hierarchy: (class, level, parent, weight). The smallest class wins ties.
    """
    up = probs.join(hierarchy, "class").groupBy("media_id", "id", "level", F.col("parent").alias("class")).agg(F.sum(F.col("prob") * F.col("weight")).alias("prob"))
    every = probs.select("media_id", "id", F.lit("0").alias("level"), "class", "prob").unionByName(up.select("media_id", "id", F.col("level").cast("string").alias("level"), "class", "prob"))
    best = Window.partitionBy("media_id", "id", "level").orderBy(F.desc("prob"), "class")
    return every.withColumn("is_best", F.row_number().over(best) == 1)


def score_of(cos: Column) -> Column:
    return (1 + cos) / 2
