"""Pairs of vectors within a distance: cells around pivots, and only cells that can hold a pair meet.

Vectors of a media go to the nearest of its pivots. By the triangle inequality no pair within r has one end in cell A,
at v, and the other in cell B, if

    |v - b| > radius(B) + r                        b: B's pivot
    (|v - b|^2 - |v - a|^2) / (2 |a - b|) > r      v's distance to the plane that parts the two cells

So v visits the cells that pass both, of higher number than its own. The cosine distance 1 - cos of unit vectors is
half the square of their distance, which is a metric. A cell of many vectors is met block by block, so a group of
copies or a cell that pruning can't part is dealt over tasks; vectors without structure visit as many cells as they
would meet blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import shared_dir

#: Pivots of a media at most; the more vectors, the larger its cells.
CELLS = 512


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    norm = np.linalg.norm(x, axis=1) if x.size else np.zeros(len(x))
    return x / np.where(norm == 0, 1, norm)[:, None]


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0)


def _reach(t: float, metric: str) -> float | None:
    """The euclidean distance (of unit vectors for cosine) within t; None: no bound, as zero vectors are near to all."""
    if metric == "cosine":
        return float(np.sqrt(2 * t)) * (1 + 1e-9) + 1e-9 if 0 <= t < 1 else None
    return t * (1 + 1e-9) + 1e-9


def _placed(emb: DataFrame, sizes: DataFrame, reach: float, metric: str, block: int) -> DataFrame:
    """(media_id, id, embedding, home, far, visits): each vector's cell, its distance to the pivot, and the cells that the parting planes let it visit."""
    kinds = dict(emb.dtypes)
    chance = F.pmod(F.xxhash64("id", "embedding"), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.least(F.lit(CELLS), F.ceil(2 * F.col("n") / block))
    picked = emb.join(sizes, "media_id").where((F.col("n") > block) & (chance < wanted / F.col("n")))
    pivots = picked.groupBy("media_id").agg(F.slice(F.sort_array(F.collect_list(F.struct(chance.alias("c"), "embedding"))), 1, CELLS).alias("p"))
    blocks = sizes.withColumn("_n", F.ceil(F.col("n") / block).cast("int")).drop("n")
    own = F.pmod(F.xxhash64("id", "embedding"), F.col("_n")).cast("int")
    dealt = emb.join(blocks, "media_id").withColumn("own", own).drop("_n")
    # columns of their own, as both sides come from one table
    asked = pivots.join(blocks, "media_id").select(F.col("media_id").alias("_m"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("own"), F.transform("p", lambda x: x["embedding"]).alias("p"))
    like = emb.select("media_id", "id", "embedding")

    def place(rows: pa.Table, pivot: pa.Table) -> pa.Table:
        n, x = len(rows), matrix(rows.column("embedding"))
        home, far, visits = np.zeros(n, np.int32), np.full(n, np.inf), [None] * n
        if len(pivot) and n:
            p = np.array(pivot.column("p")[0].as_py(), np.float64)
            x, p = (unit(x), unit(p)) if metric == "cosine" else (x, p)
            p = np.unique(p, axis=0)
            square = _squares(x, p)
            home = square.argmin(1).astype(np.int32)
            own = square[np.arange(n), home]
            apart = np.sqrt(_squares(p, p))[home]
            plane = (square - own[:, None]) / np.where(apart == 0, 1, 2 * apart)
            near = (plane <= reach) & (np.arange(len(p))[None, :] > home[:, None])
            far = np.sqrt(own)
            visits = [[{"cell": int(c), "far": float(d)} for c, d in zip(at, np.sqrt(row[at]), strict=True)] for row, at in zip(square, map(np.flatnonzero, near), strict=True)]
        kept = rows.select(["media_id", "id", "embedding"])
        kind = pa.list_(pa.struct([("cell", pa.int32()), ("far", pa.float64())]))
        return kept.append_column("home", pa.array(home)).append_column("far", pa.array(far)).append_column("visits", pa.array(visits, kind))

    schema = f"media_id {kinds['media_id']}, id {kinds['id']}, embedding {kinds['embedding']}, home int, far double, visits array<struct<cell:int,far:double>>"
    shared_dir(emb.sparkSession)
    return dealt.select(*like.columns, "own").groupBy("media_id", "own").cogroup(asked.groupBy("_m", "own")).applyInArrow(place, schema).checkpoint()


def _visitors(placed: DataFrame, reach: float) -> DataFrame:
    """(media_id, id, embedding, home, cell): vectors in the cells that they visit."""
    radii = placed.groupBy("media_id", F.col("home").alias("cell")).agg(F.max("far").alias("radius"))
    asked = placed.select("media_id", "id", "embedding", "home", F.explode("visits").alias("v")).select("media_id", "id", "embedding", "home", "v.cell", "v.far")
    return asked.join(radii, ["media_id", "cell"]).where(F.col("far") <= F.col("radius") + reach)


def _prepared(emb: DataFrame) -> tuple[DataFrame, DataFrame]:
    some = emb.where("embedding is not null").select("media_id", "id", "embedding")
    return some, some.groupBy("media_id").agg(F.count("*").alias("n"))


def meetings(emb: DataFrame, t: float, metric: str, block: int, work: Callable[[pa.Table, bool], pa.Table], schema: str) -> DataFrame:
    """work(rows, same) of every two blocks that can hold a pair within t; rows: (id, embedding, first BOOLEAN), same: the block meets itself.

    Medias of up to `block` vectors are one cell each, so where all are such no pivot is looked for.
    """
    reach = _reach(t, metric)
    some, sizes = _prepared(emb)
    largest = sizes.agg(F.max("n")).first()[0] or 0
    if reach is None or largest <= block:
        home = some.withColumn("cell", F.lit(0))
        guests = None
    else:
        placed = _placed(some, sizes, reach, metric, block)
        home = placed.select("media_id", "id", "embedding", F.col("home").alias("cell"))
        guests = _visitors(placed, reach).select("media_id", "id", "embedding", "cell")
    count = lambda df, name: df.groupBy("media_id", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    held = count(home, "_h")
    held = held.withColumn("_v", F.lit(0)) if guests is None else held.join(count(guests, "_v"), ["media_id", "cell"], "left").na.fill(0, ["_v"])
    own = lambda n: F.pmod(F.xxhash64("id", "embedding"), F.col(n)).cast("int")
    rows = home.join(held, ["media_id", "cell"]).withColumns({"own": own("_h"), "other": F.explode(F.sequence(F.lit(0), F.col("_h") + F.col("_v") - 1))})
    if guests is not None:
        met = guests.join(held, ["media_id", "cell"]).withColumns({"own": F.col("_h") + own("_v"), "other": F.explode(F.sequence(F.lit(0), F.col("_h") - 1))})
        rows = rows.unionByName(met)
    rows = rows.select("media_id", "cell", "id", "embedding", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def run(table: pa.Table) -> pa.Table:
        own, lo, hi = (table.column(c).to_numpy() for c in ("own", "lo", "hi"))
        return work(table.select(["id", "embedding"]).append_column("first", pa.array(own == lo)), bool((lo == hi).all()))

    return rows.groupBy("media_id", "cell", "lo", "hi").applyInArrow(run, schema)


def met_cells(emb: DataFrame, t: float, metric: str = "cosine", block: int = 4_096) -> DataFrame:
    """(media_id, cells, possible, met): of the pairs of different cells of each media those that meet."""
    reach = _reach(t, metric)
    some, sizes = _prepared(emb)
    if reach is None:
        raise ValueError("no pair of cells can be ruled out at this distance")
    placed = _placed(some, sizes, reach, metric, block)
    cells = placed.groupBy("media_id").agg(F.count_distinct("home").alias("cells"))
    met = _visitors(placed, reach).select("media_id", "home", "cell").distinct().groupBy("media_id").agg(F.count("*").alias("met"))
    return cells.join(met, "media_id", "left").na.fill(0, ["met"]).select("media_id", "cells", (F.col("cells") * (F.col("cells") - 1) / 2).cast("long").alias("possible"), "met")
