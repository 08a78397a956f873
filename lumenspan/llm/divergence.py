"""How far the sources of each language differ in their use of words, and by which words.

Terms are counted by (lang, source) in Arrow batches. A kept term's counts in all sources of its language are one
column vector; terms of the same vector are counted once with their number (the length of a run). In blocks of the
vocabulary the vectors are sorted, so that equal counts stand together, and each source's column is run-length
encoded. A pair of sources intersects the boundaries of its two columns' runs; f is computed once for each piece and
multiplied by the number of terms in it. Blocks add up in Spark, so no task sees a whole vocabulary.

    p = 1 + floor(10^9 * (count + 2) / (N + 2V))      f = floor((p - q)^2 / (p + q))

All arithmetic is in whole numbers: 64-bit where counts allow it, decimals or Python's integers beyond.

Defined results: null text, lang and source are empty strings, so rows of them form groups of their own; each row is a
document, repeated rows and ids count each; texts are taken whole, of any length; a group without terms has count 0
for all kept terms; a language without kept terms has pairs of value 0 and no terms; a language of one source has no
pairs; equal values are ranked by the item's bytes; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, column, materialise, partitions, steps, table

#: A language keeps the terms of at least so many of its documents.
LEAST_DOCUMENTS = 10
#: Terms of a group that are reported.
TOP = 10
UNIT = 1_000_000_000
#: Bytes of text of one step.
STEP = 8_000_000
#: Cells (terms x sources) of a block of the vocabulary at most, and terms of one at least where a partition gets several.
CELLS, FEW = 1 << 21, 1024
#: Columns by which vectors are sorted; the others follow as they fall.
SORTED_BY = 24

#: Bytes of a term: letters of ASCII and all of other characters, A-Z as a-z; 0 elsewhere.
_TERM = np.arange(256, dtype=np.uint8)
_TERM[65:91] += 32
_TERM[:65] = _TERM[91:97] = _TERM[123:128] = 0


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The text and the code of every term of a batch, and the distinct terms."""
    raw = texts.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = _TERM[np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    starts = ends[:-1] - ends[0]
    inside = data > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = starts[np.diff(ends) > 0]
    begins[first] = inside[first]  # no term reaches across texts
    at = np.flatnonzero(begins)
    place = np.cumsum(inside)
    offsets = np.concatenate([place[at] - 1, [int(place[-1]) if len(place) else 0]]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside])))
    coded = words.dictionary_encode()
    return np.searchsorted(starts, at, "right") - 1, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, tf, df) of each step."""
    for b in steps(batches, most=STEP):
        doc, code, terms = terms_of(column(b, "text"))
        if not len(code):
            continue
        lang, source = column(b, "lang"), column(b, "source")
        first: dict[tuple, int] = {}  # the first row of each group stands for it
        of_doc = np.array([first.setdefault(g, i) for i, g in enumerate(zip(lang.to_pylist(), source.to_pylist(), strict=True))], np.int64)
        key, tf = np.unique(doc * len(terms) + code, return_counts=True)  # a row for each document and term
        key, at = np.unique(of_doc[key // len(terms)] * len(terms) + key % len(terms), return_inverse=True)
        row, term = pa.array(key // len(terms)), pa.array(key % len(terms))
        sums = [pa.array(np.bincount(at, w, len(key)).astype(np.int64)) for w in (tf, None)]
        yield pa.RecordBatch.from_arrays([lang.take(row), source.take(row), terms.take(term).cast(pa.string()), *sums], ["lang", "source", "term", "tf", "df"])


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """p of counts; total is N + 2V."""
    if count.max(initial=0) < 9_000_000_000 and total < 9_000_000_000_000_000_000:
        return 1 + (count + 2) * UNIT // total
    return np.array([1 + (int(c) + 2) * UNIT // total for c in count], np.int64)


class Runs:
    """A source's column as runs: the place where each ends, in terms, and p of its count."""

    def __init__(self, counts: np.ndarray, places: np.ndarray, total: int):
        last = np.flatnonzero(np.concatenate([counts[1:] != counts[:-1], [True]]))
        self.ends, self.p = places[last], shares(counts[last], total)

    def difference(self, other: Runs) -> int:
        """Sum of f over all terms of the block: boundaries of both are intersected, f counts once for each piece."""
        ends = np.union1d(self.ends, other.ends)
        p, q = self.p[np.searchsorted(self.ends, ends)], other.p[np.searchsorted(other.ends, ends)]
        return int(((p - q) * (p - q) // (p + q) * np.diff(ends, prepend=0)).sum())


def encode(counts: np.ndarray, times: np.ndarray, totals: list[int]) -> list[Runs]:
    """Run-length columns of a block: counts (vectors by sources), how many terms have each vector, N + 2V of each source."""
    dense = np.argsort(-(counts > 0).sum(0), kind="stable")[:SORTED_BY]
    order = np.lexsort([counts[:, s] for s in dense[::-1]])  # the column with the most counts leads
    places = np.cumsum(times[order])
    return [Runs(counts[order, s], places, totals[s]) for s in range(counts.shape[1])]


def _block(vectors: pa.Table, sources: pa.Table) -> pa.Table:
    names = ["lang", "source", "item", "value"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    if not len(vectors) or len(sources) < 2:
        return pa.table([pa.array([], k) for k in kinds], names)
    vectors, sources = vectors.combine_chunks(), sources.combine_chunks().sort_by("source")
    lists, known = vectors.column("counts").combine_chunks(), sources.column("source").combine_chunks()
    flat = lists.flatten()
    counts = np.zeros((len(vectors), len(sources)), np.int64)
    row = np.repeat(np.arange(len(vectors)), np.diff(lists.offsets.to_numpy()))
    counts[row, pa.compute.index_in(flat.field(0), value_set=known).to_numpy(zero_copy_only=False)] = flat.field(1).to_numpy(zero_copy_only=False)
    runs = encode(counts, vectors.column("times").to_numpy(), [n + 2 * v for n, v in zip(*(sources.column(c).to_pylist() for c in ("n", "v")), strict=True)])
    a, b = np.triu_indices(len(runs), 1)
    value = pa.array([runs[s].difference(runs[t]) for s, t in zip(a.tolist(), b.tolist(), strict=True)], pa.int64())
    lang = pa.array([sources.column("lang")[0].as_py()] * len(a), pa.string())
    both = [pa.table([lang, known.take(pa.array(x)), known.take(pa.array(y)), value], names) for x, y in ((a, b), (b, a))]
    return pa.concat_tables(both).cast(pa.schema(list(zip(names, kinds, strict=True))))


def _share(count: Column, total: Column) -> Column:
    """p in SQL: an exact decimal product, then whole division."""
    return 1 + F.call_function("div", (count + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), total.cast("decimal(20,0)"))


def audit(documents: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` has each other source of the language, `term` the first `top` terms."""
    spark = documents.sparkSession
    bounded_batches(spark)
    rows = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counted = rows.mapInArrow(count_terms, "lang string, source string, term string, tf long, df long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    terms = counted.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"), F.sort_array(F.collect_list(F.struct("source", "tf"))).alias("counts"))
    terms = materialise(terms.where(F.col("df") >= least).drop("df"), "divergence-terms")
    each = terms.select("lang", "term", F.col("tf").alias("all"), F.explode("counts").alias("c")).select("lang", "term", "all", "c.source", "c.tf")
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("tf").alias("lang_n"))
    groups = rows.select("lang", "source").distinct().join(each.groupBy("lang", "source").agg(F.sum("tf").alias("n")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialise(groups.na.fill(0, ["n", "v", "lang_n"]), "divergence-groups")

    # part pair: blocks of vectors meet the sources of their language
    per = F.greatest(F.lit(1), F.ceil(F.count("*") * F.max("v") / cells), F.least(F.lit(partitions(spark)), F.floor(F.max("v") / FEW)))
    blocks = groups.where("v > 0").groupBy("lang").agg(per.cast("long").alias("blocks"))
    vectors = terms.groupBy("lang", "counts").agg(F.count("*").alias("times")).join(blocks, "lang")
    vectors = vectors.withColumn("block", F.pmod(F.xxhash64("counts"), F.col("blocks"))).drop("blocks")
    met = groups.join(blocks, "lang").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sums = vectors.groupBy("lang", "block").cogroup(met.groupBy("lang", "block")).applyInArrow(_block, "lang string, source string, item string, value long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").na.fill(0, ["value"]).withColumn("part", F.lit("pair"))

    # part term: what a source has more of than its language
    known = each.join(groups, ["lang", "source"])
    known = known.withColumns({"p": _share(F.col("tf"), F.col("n") + 2 * F.col("v")), "q": _share(F.col("all"), F.col("lang_n") + 2 * F.col("v"))}).where("p > q")
    found = known.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", rank).select(*columns).unionByName(found.select(*columns))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of sources and the first ten terms of every group of `documents`."""
    return audit(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, source, doc, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS tf, count(DISTINCT doc) AS df FROM w GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(tf) AS BIGINT) AS tf FROM c GROUP BY ALL HAVING sum(df) >= {LEAST_DOCUMENTS}),
l AS (SELECT lang, count(*) AS v, CAST(sum(tf) AS BIGINT) AS n FROM k GROUP BY lang),
s AS (SELECT DISTINCT lang, source FROM d),
a AS (SELECT s.lang, s.source, k.term, k.tf AS lang_tf, coalesce(c.tf, 0) AS tf FROM s JOIN k ON s.lang = k.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
p AS (SELECT a.lang, a.source, term, tf, 1 + ({UNIT} * (tf + 2)) // (CAST(sum(tf) OVER (PARTITION BY a.lang, a.source) AS BIGINT) + 2 * l.v) AS p, 1 + ({UNIT} * (lang_tf + 2)) // (l.n + 2 * l.v) AS q FROM a JOIN l ON a.lang = l.lang),
v AS (SELECT x.lang, x.source, y.source AS item, CAST(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS BIGINT) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(v.value, 0) AS value FROM s x JOIN s y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN v ON v.lang = x.lang AND v.source = x.source AND v.item = y.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE tf > 0 AND p > q),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM n WHERE part = 'pair' OR rank <= {TOP}
"""
