"""Exact top-k inner products by no-random-access aggregation.

The rows are cut into blocks. Each block has a list for each component, sorted once by value and stored with the
block; a query reads the lists of its components in step from their better end, and knows the value at their other
end. At each depth a row has

    lower = what has been read of it + for each list not yet met the worst value in it
    upper = what has been read of it + for each list not yet met the value just read, the best that is left
    unseen = the score of a row at the place just read in every list, the upper bound of rows not met at all

The query's bar is the largest of its k-th best lower bound in the block and the k-th score it brought along. A row
whose upper bound is below the bar can't qualify. Reading stops when only few can (RESOLVE at most), or at the end of
the lists; then the scores of those few are resolved and merged. The bar carries over from block to block: each block
of queries first meets one block of rows, and its k-th scores go with it to all others. All queries of a block read in
step, so a depth is a product of matrices, and lower bounds are computed only as long as an unread row could still
reach the bar. On vectors without structure, whose components say little each, half of every list has to be read
before the bounds part rows (DEPTHS are the depths at which they are looked at).

Final scores are 64-bit integers; bounds are exact in float32 up to 2^24, in float64 up to 2^53, and widened beyond.

Defined results: vectors that are null, empty, of null id, or hold null or
non-finite components take no part; vectors of other lengths aren't compared;
a row is its query's own if ids are equal, and repeated rows count one by one;
ties go to the smaller vec_id; rows with one id that is asked for all ask, and the
best of all their scores are ranked together; empty tables give no rows; other
columns of the table are not looked at. A vector is one value, whatever its length.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

BLOCK, QUERIES = 2_048, 2_048
#: Depths of the lists, as shares, at which bounds are compared with the bar.
DEPTHS = (*(i / 32 for i in range(1, 5)), *(i / 16 for i in range(3, 17)))
RESOLVE = 48


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, e): floor(scale * x) of each component, for the vectors that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("e"))


class Lists:
    """The sorted lists of a block (order: of each component the rows from the largest value on), and each row's place in them."""

    def __init__(self, x: np.ndarray, order: np.ndarray | None = None):
        self.x, self.n = x, len(x)
        self.order = np.argsort(-x, axis=0, kind="stable") if order is None else order
        self.sorted = np.take_along_axis(x, self.order, 0)
        self.place = np.empty(x.shape, np.int32)
        np.put_along_axis(self.place, self.order, np.arange(self.n, dtype=np.int32)[:, None], 0)

    def of(self, kind: type) -> Lists:
        """The same lists with values of another kind."""
        out = object.__new__(Lists)
        out.x, out.n, out.order, out.sorted, out.place = self.x.astype(kind), self.n, self.order, self.sorted.astype(kind), self.place
        return out

    def unseen(self, high: np.ndarray, low: np.ndarray, depth: int) -> np.ndarray:
        """The best score of a row that no list has shown at this depth."""
        if depth >= self.n:
            return np.full(len(high), -np.inf)
        return high @ self.sorted[depth - 1] + low @ self.sorted[self.n - depth]

    def _bound(self, high, low, depth, down, up) -> np.ndarray:
        """Of queries (positive and negative parts) by rows: what was read, with these values for what was not."""
        return high @ np.where(self.place < depth, self.x, down).T + low @ np.where(self.place >= self.n - depth, self.x, up).T

    def upper(self, high: np.ndarray, low: np.ndarray, depth: int) -> np.ndarray:
        return self._bound(high, low, depth, self.sorted[depth - 1], self.sorted[self.n - depth])

    def lower(self, high: np.ndarray, low: np.ndarray, depth: int) -> np.ndarray:
        return self._bound(high, low, depth, self.sorted[-1], self.sorted[0])


def _merge(best: pd.DataFrame, more: pd.DataFrame, k: int) -> pd.DataFrame:
    both = pd.concat([best, more], ignore_index=True).sort_values(["q", "score", "vec_id"], ascending=[True, False, True])
    return both[both.groupby("q").cumcount() < k]


def search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, bar: np.ndarray | None = None, depths: list | None = None) -> pd.DataFrame:
    """q (number of the query), vec_id, score: the k best rows of each query that reach its bar, block by block.

    depths, if given, gets the share of the lists that each query read, block by block.
    """
    best = pd.DataFrame({"q": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})
    bar = np.full(len(q), -np.inf) if bar is None else bar.astype(float)
    for start in range(0, len(x), BLOCK):
        best = _merge(best, search_lists(q_ids, q, ids[start : start + BLOCK], Lists(x[start : start + BLOCK].astype(np.int64)), k, bar, depths), k)
        full = best.groupby("q").score.agg(["size", "min"])
        full = full[full["size"] >= k]
        bar[full.index.to_numpy()] = np.maximum(bar[full.index.to_numpy()], full["min"].to_numpy())
    return best


def search_lists(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, lists: Lists, k: int, bar: np.ndarray, depths: list | None = None) -> pd.DataFrame:
    """search() in the lists of one block."""
    q, whole, n = q.astype(np.int64), lists, lists.n
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(lists.x).max(initial=0)) * q.shape[1]
    kind = np.float32 if largest < 2**24 else np.float64
    slack = largest * 1e-12 if largest >= 2**53 else 0.0
    lists = lists.of(kind)
    high, low = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
    bar, open_, found = bar.astype(float), np.arange(len(q)), []
    own = ids[None, :] == q_ids[:, None]
    for depth in np.unique(np.ceil(np.array(DEPTHS) * n).astype(int)):
        # as long as an unread row could qualify, the k-th best lower bound may raise the bar
        unsure = open_[lists.unseen(high[open_], low[open_], depth) + slack >= bar[open_]]
        if len(unsure) and n >= k:
            lower = np.where(own[unsure], -np.inf, lists.lower(high[unsure], low[unsure], depth))
            bar[unsure] = np.maximum(bar[unsure], np.partition(lower, n - k, axis=1)[:, n - k] - slack)
        can = (lists.upper(high[open_], low[open_], depth) + slack >= bar[open_, None]) & ~own[open_]
        over = (can.sum(1) <= RESOLVE) | (depth == n)
        if depths is not None:
            depths += [depth / n] * int(over.sum())
        at, row = np.nonzero(can & over[:, None])
        if len(at):
            at = open_[at]
            score = np.concatenate([np.einsum("ij,ij->i", q[at[i : i + 65_536]], whole.x[row[i : i + 65_536]]) for i in range(0, len(at), 65_536)])
            # at the end of the lists many may be left: a query's k best of the block go on
            order = np.lexsort((ids[row], -score, at))
            new = np.concatenate([[True], at[order][1:] != at[order][:-1]])
            nth = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            keep = order[nth < k]
            found.append(pd.DataFrame({"q": at[keep], "vec_id": ids[row[keep]], "score": score[keep]}))
        open_ = open_[~over]
        if not len(open_):
            break
    return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"q": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})


def stored_lists(vectors: DataFrame, blocks: int) -> DataFrame:
    """(b, dim, ids, x, places): the rows of each block and of each length, with their sorted lists, in a table."""

    def build(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        x = t.column("e").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
        lists = Lists(x)
        values = [t.column("b")[0].as_py(), dim, t.column("vec_id").to_numpy().astype("<i8").tobytes(), x.astype("<i8").tobytes(), lists.order.astype("<u4").tobytes()]
        return pa.table([pa.array([v], kind) for v, kind in zip(values, [pa.int32(), pa.int32(), *[pa.binary()] * 3], strict=True)], ["b", "dim", "ids", "x", "places"])

    rows = dealt(vectors, "b", blocks).withColumn("dim", F.size("e"))
    return materialise(rows.groupBy("b", "dim").applyInArrow(build, "b int, dim int, ids binary, x binary, places binary"), "topk-lists")


def dealt(vectors: DataFrame, name: str, cells: int) -> DataFrame:
    """Rows with their cell, by id, vector and a number of the row, so that rows of one id are spread."""
    return vectors.withColumn(name, F.pmod(F.xxhash64("vec_id", "e", F.monotonically_increasing_id()), F.lit(cells)).cast("int"))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score; queries and vectors: (vec_id, e) with integer components.

    Every block of queries meets every block of rows, as the task is all queries
    against all rows; a task holds one block of each. A block's lists are sorted once,
    for all blocks of queries.
    """
    blocks = max(1, math.ceil(vectors.count() / BLOCK))
    q_blocks = max(1, math.ceil(queries.count() / QUERIES))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = stored_lists(vectors, blocks).withColumn("a", numbers(q_blocks))
    # written once, as what meets in two passes has to be dealt alike
    asked = materialise(dealt(queries, "a", q_blocks), "topk-queries").withColumn("dim", F.size("e")).withColumn("b", numbers(blocks))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        block = right.iloc[0]
        x, places = (np.frombuffer(block[c], kind).astype(np.int64).reshape(-1, block.dim) for c, kind in (("x", "<i8"), ("places", "<u4")))
        ids, bar = left.vec_id.to_numpy(), left.bar.to_numpy(float)
        best = search_lists(ids, np.stack(left.e.to_numpy()), np.frombuffer(block.ids, "<i8"), Lists(x, places), k, np.where(np.isnan(bar), -np.inf, bar))
        found = pd.DataFrame({"query_id": ids[best.q.to_numpy()], "vec_id": best.vec_id, "score": best.score})
        found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return found[found.groupby("query_id").cumcount() < k]

    cells = lambda ask, hold: ask.groupBy("a", "b", "dim").cogroup(hold.groupBy("a", "b", "dim")).applyInPandas(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    # each block of queries meets one block of rows for a bar, and then the others
    home = F.col("b") == F.col("a") % blocks
    none = F.lit(None).cast("double")
    near = materialise(cells(asked.where(home).withColumn("bar", none), held.where(home)), "topk-home")
    bars = near.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bar"))
    others = cells(asked.where(~home).join(bars, "vec_id", "left"), held.where(~home))
    return near.unionByName(others).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for every row whose id is divisible by 50."""
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
