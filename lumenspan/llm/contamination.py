"""Benchmark passages inside documents: size-partitioned MinHash containment search.

Items are partitioned by size (number of distinct word shingles, by powers of the
square root of two). For a partition whose largest item has u shingles, a document is
read in windows of 2u shingles, u apart, so that a passage of up to u lies whole in
one of them, however long the document is. An item of n shingles, a share c of which
is in the window, has a Jaccard similarity of at least c n / (2u + n - c n) to it: at
c = 0.8 that is 0.36 for the largest item of a partition (n = u) and 0.26 for the
smallest (n = u / sqrt 2). A window is a candidate for an item if one of HASHES minima
agrees; all disagree in at most (1 - 0.26)^HASHES of cases, 6 in 100,000. Candidates
are verified by exact containment: the share of the item's distinct shingles that
occur anywhere in the document.

Documents pass once for each block of about ITEMS benchmark items and BYTES of their
text, which bounds what is sent to the tasks, whatever the benchmark's size. Equal
items of a block are one.

Defined results: null texts, and texts without words, match nothing on either
side; items of fewer than five words have one shingle, all of their words (found
only in documents that are no longer, since a word or two would mark clean documents);
texts of any length are read whole; repeated rows give one row for each pair of ids;
rows of a null id have no pair, but drop_rows judges them, and searches for items of
null id; empty tables give no rows; drop_rows keeps all columns, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, bounded_batches, column, distinct_by_doc, materialise, mix, shingles, sorted_distinct, steps, table

CONTAINMENT = 0.8
HASHES = 32
#: Benchmark items, and bytes of their text, of a block, about (by a hash; a longer item is a block's own).
ITEMS, BYTES = 20_000, 64_000_000
_ODD = np.random.default_rng(99).integers(1, 1 << 62, size=HASHES, dtype=np.int64).view(np.uint64) | np.uint64(1)


def _hashed(ids: np.ndarray, k: int) -> np.ndarray:
    return mix(ids * _ODD[k])


class Index:
    """The signatures of a block of items by size partition, and their shingles."""

    def __init__(self, item_ids: np.ndarray, texts: pa.Array):
        coded = texts.cast(pa.large_string()).dictionary_encode()
        ids, _, offsets = distinct_by_doc(*shingles(Words(coded.dictionary)))
        self.ids, self.offsets = ids, offsets
        # the items of each distinct text
        codes = coded.indices.to_numpy()
        self.item_ids, self.of_text = item_ids[np.argsort(codes, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))])
        n = np.diff(offsets)
        full = np.flatnonzero(n > 0)
        least = [np.minimum.reduceat(_hashed(ids, k), offsets[full]) if len(full) else np.empty(0, np.uint64) for k in range(HASHES)]
        level = np.ceil(2 * np.log2(np.maximum(n[full], 1)) - 1e-9)
        self.parts = []
        for one in np.unique(level):
            mine = np.flatnonzero(level == one)
            items = full[mine]
            if len(items):
                minima = [x[mine] for x in least]
                order = [np.argsort(m, kind="stable") for m in minima]
                self.parts.append((int(n[items].max()), items, [m[o] for m, o in zip(minima, order, strict=True)], order))

    def candidates(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Pairs (document, item) to verify, as document << 32 | item; ids: all shingles of each document in order."""
        found = [np.empty(0, np.int64)]
        n = np.diff(offsets)
        full = np.flatnonzero(n > 0)
        if not len(full):
            return found[0]
        # half windows of u shingles; a window is two of them in a row
        halves = []
        for u, _, _, _ in self.parts:
            count = -(-n[full] // u)
            first = np.repeat(offsets[full], count) + u * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            doc = np.repeat(full, count)
            halves.append((first, doc, np.concatenate([doc[1:] == doc[:-1], [False]])))
        for k in range(HASHES):
            h = _hashed(ids, k)
            for (_, items, minima, order), (first, doc, more) in zip(self.parts, halves, strict=True):
                low = np.minimum.reduceat(h, first)
                low[:-1] = np.where(more[:-1], np.minimum(low[:-1], low[1:]), low[:-1])
                left = np.searchsorted(minima[k], low, "left")
                hit = np.flatnonzero((left < len(items)) & (minima[k][np.minimum(left, len(items) - 1)] == low))
                if len(hit):
                    size = np.searchsorted(minima[k], low[hit], "right") - left[hit]
                    at = np.repeat(left[hit] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    found.append(sorted_distinct((np.repeat(doc[hit], size) << 32) | items[order[k][at]]))
        return sorted_distinct(np.concatenate(found))

    def verify(self, pairs: np.ndarray, ids: np.ndarray, offsets: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        docs, items = pairs >> 32, pairs & 0xFFFFFFFF
        share = np.zeros(len(pairs))
        cuts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(pairs) else np.empty(0, np.int64)
        for a, b in zip(cuts, np.append(cuts, len(pairs))[1:], strict=True):
            own = sorted_distinct(ids[offsets[docs[a]] : offsets[docs[a] + 1]])
            for j in range(a, b):
                wanted = self.ids[self.offsets[items[j]] : self.offsets[items[j] + 1]]
                at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                share[j] = (own[at] == wanted).mean()
        keep = share >= least - 1e-9
        return docs[keep], items[keep], share[keep]

    def named(self, docs: np.ndarray, items: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, ids of items and containments, with every item of each text."""
        n = self.of_text[items + 1] - self.of_text[items]
        at = np.repeat(self.of_text[items] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(docs, n), self.item_ids[at], np.repeat(share, n)


def _passes(documents: DataFrame, benchmark: DataFrame, items: int, one: Callable[[DataFrame, object], DataFrame], chained: bool) -> list[DataFrame]:
    """Results of one(documents, broadcast index) for each block of (item_id, text); chained: each works on what the one before it gave.

    One index lives at a time: where there are several, each pass is written before the next index is made.
    """
    spark = benchmark.sparkSession
    n, size = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks, out = max(1, math.ceil(n / items), math.ceil(size / BYTES)), []
    for block in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()
        shared = spark.sparkContext.broadcast(Index(part["item_id"].to_numpy().astype(np.int64), part["text"].combine_chunks()) if part.num_rows else None)
        found = one(documents, shared)
        if blocks > 1:
            found = materialise(found, "decontamination")
            shared.destroy()
        documents = found if chained else documents
        out.append(found)
    return out


def matches(documents: DataFrame, benchmark: DataFrame, least: float = CONTAINMENT, items: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, containment) of the pairs whose containment is at least `least`."""
    bounded_batches(documents.sparkSession)
    # repeated rows count once
    benchmark = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def one(rows: DataFrame, shared) -> DataFrame:
        def run(batches):
            index = shared.value
            for b in steps(batches):
                if index is None:
                    continue
                ids, offsets = shingles(Words(column(b, "text")))
                docs, found, share = index.named(*index.verify(index.candidates(ids, offsets), ids, offsets, least))
                yield pa.RecordBatch.from_arrays([column(b, "doc_id").take(pa.array(docs)), pa.array(found), pa.array(share)], ["doc_id", "item_id", "containment"])

        return rows.mapInArrow(run, "doc_id long, item_id long, containment double")

    found = functools.reduce(DataFrame.unionByName, _passes(rows, benchmark, items, one, False))
    return found.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def drop_rows(documents: DataFrame, benchmark: DataFrame, least: float = CONTAINMENT, items: int = ITEMS) -> DataFrame:
    """The rows whose own text holds no benchmark text, whatever the ids on either side, null or repeated."""
    bounded_batches(documents.sparkSession)
    texts = benchmark.where("text is not null").select("text").distinct().select(F.xxhash64("text").alias("item_id"), "text")

    def one(rows: DataFrame, shared) -> DataFrame:
        def run(batches):
            index = shared.value
            for b in steps(batches):
                keep = np.ones(b.num_rows, bool)
                if index is not None:
                    ids, offsets = shingles(Words(column(b, "text")))
                    keep[index.verify(index.candidates(ids, offsets), ids, offsets, least)[0]] = False
                yield b.filter(pa.array(keep))

        return rows.mapInArrow(run, documents.schema)

    return _passes(documents, texts, items, one, True)[-1]


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Exact containment of five-word shingles by join; items of fewer words are compared as a whole.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:least(i + 4, len(w))], ' ') AS s FROM d, unnest(range(1, greatest(2, len(w) - 3))) AS u(i) WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:least(i + 4, len(w))], ' ') AS s FROM b, unnest(range(1, greatest(2, len(w) - 3))) AS u(i) WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS c FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, c / CAST(n AS DOUBLE) AS containment FROM m JOIN n USING (item_id) WHERE c >= 0.8 * n - 1e-9
"""
