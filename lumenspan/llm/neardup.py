"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of its five-word shingles: weight = tf * idf with

    idf(s) = 1 + ln(N / max(df(s), f)) / ln(N / f),    f = RARE * N (1 at least)

so idf runs from 1 (in all texts) to 2 (in at most a fraction RARE of them; the
smoothing keeps a large group of copies from lowering the weight of its own
shingles below that of its edits by more than a factor of two). df counts texts
in CELLS hashed cells over the whole corpus, so only cells above f, of which
there are CELLS at most, have to be sent to the tasks.

1. BANDS * ROWS consistent weighted samples of each text; ROWS of them make a band.
2. Texts with the same words are one representative from here on.
3. Representatives that share a band are compared. Small buckets give pairs; in
   large ones blocks of BLOCK texts meet block by block inside tasks, and each
   meeting gives only a spanning forest of its links, so a bucket never gives
   all of its pairs, and no task holds a whole bucket.
4. A link is a weighted Jaccard similarity of at least THRESHOLD, computed from
   all shingles. Connected components over links are the classes.

Defined results: null texts and texts without words are alike to nothing (their
own classes); texts of one to four words have one shingle, all of their words;
texts of any length are read whole; rows with the same words, in any case and
spacing, are copies; rows of one id
with different texts are documents of their own; class_id is the smallest doc_id
of the class; a row without doc_id is its own class, with a null class_id, and
always stays. An empty table gives no rows; keep_first keeps all columns, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components, spanning_forest
from ..operators.skew import join_counted
from .common import Words, binary_lists, bounded_batches, column, distinct_by_doc, materialise, mix, release, shingles, steps, table

THRESHOLD = 0.8
BANDS, ROWS = 14, 4
RARE = 0.01
CELLS = 1 << 18
#: Buckets of up to so many texts give pairs; in larger ones blocks of BLOCK texts meet.
SMALL, BLOCK = 48, 384
_LEVELS = 1 << 16


def _cells(ids: np.ndarray) -> np.ndarray:
    return (ids >> np.uint64(30)).astype(np.int64)


def _count_cells(batches):
    """How many texts of this partition have a shingle in each cell."""
    total = np.zeros(CELLS, np.int64)
    for b in steps(batches):
        ids, offsets = shingles(Words(column(b, "text")))
        ids, _, offsets = distinct_by_doc(ids, offsets)
        total += np.bincount(_cells(ids), minlength=CELLS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["cell", "n"])


class Idf:
    """idf of each shingle by its cell."""

    def __init__(self, documents: DataFrame):
        self.n = max(1, documents.count())
        self.floor = max(1.0, RARE * self.n)
        cells = documents.select("text").mapInArrow(_count_cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        above = cells.where(F.col("n") > self.floor).toArrow()  # CELLS rows at most
        self.idf = np.full(CELLS, 2.0 if self.n > self.floor else 1.0)
        if above.num_rows and self.n > self.floor:
            self.idf[above["cell"].to_numpy()] = 1 + np.log(self.n / np.minimum(above["n"].to_numpy(), self.n)) / np.log(self.n / self.floor)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.idf[_cells(ids)]


def _tables(rng=np.random.default_rng(20_240_601)):
    """Draws of r and c from Gamma(2, 1) and of beta from U(0, 1), reached by hashed shingle."""
    u = rng.random((5, _LEVELS))
    u[:4] = np.maximum(u[:4], 1e-9)
    return (-np.log(u[0] * u[1])).astype(np.float32), np.log(-np.log(u[2] * u[3])).astype(np.float32), u[4].astype(np.float32)


_R, _LNC, _BETA = _tables()


def _sample(index: np.ndarray, lnw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln a and t of improved consistent weighted sampling."""
    r = _R[index]
    t = np.floor(lnw / r + _BETA[index])
    return _LNC[index] - r * (t - _BETA[index]) - r, t


class Signer:
    def __init__(self, idf: np.ndarray, bands: int = BANDS, rows: int = ROWS):
        self.idf, self.bands, self.rows = idf, bands, rows
        self.usual = np.float32(np.log(idf.max()))
        self.usual_a, self.usual_t = _sample(np.arange(_LEVELS), np.full(_LEVELS, self.usual, np.float32))
        self.odd = np.random.default_rng(7).integers(1, 1 << 62, size=(bands * rows, 2), dtype=np.int64).view(np.uint64) | np.uint64(1)

    def bands_of(self, ids: np.ndarray, tf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One 64-bit key for each text that has shingles, and each band."""
        starts, n = offsets[:-1], np.diff(offsets)
        full = n > 0
        starts, n = starts[full], n[full]
        lnw = np.log(tf * self.idf[_cells(ids)]).astype(np.float32)
        other = np.flatnonzero(np.abs(lnw - self.usual) > 1e-6)
        out = np.empty((self.bands, len(starts)), np.uint64)
        doc = np.repeat(np.arange(len(starts)), n)
        for band in range(self.bands):
            key = np.full(len(starts), np.uint64(band + 1), np.uint64)
            for row in range(self.rows):
                a1, a2 = self.odd[band * self.rows + row]
                index = ((ids * a1 + a2) >> np.uint64(48)).astype(np.int32)
                a = self.usual_a[index]
                if len(other):
                    a[other], t_other = _sample(index[other], lnw[other])
                least = np.minimum.reduceat(a, starts)
                hit = np.flatnonzero(a == least[doc])
                _, first = np.unique(doc[hit], return_index=True)
                at = hit[first]
                t = self.usual_t[index[at]]
                if len(other):
                    pos = np.minimum(np.searchsorted(other, at), len(other) - 1)
                    t = np.where(other[pos] == at, t_other[pos], t)
                key = mix(key ^ mix(ids[at] * np.uint64(2_654_435_761) + t.astype(np.int64).view(np.uint64)))
            out[band] = key
        return out.T


def _features(ids: np.ndarray, tf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids with a repeat for each occurrence: the j-th occurrence of a shingle is an item of its own."""
    return np.repeat(ids, tf), np.concatenate([[0], np.cumsum(tf)])[offsets]


def jaccard_items(ids: np.ndarray) -> np.ndarray:
    """Items of one text: distinct numbers for the occurrences of its (sorted) shingles."""
    if not len(ids):
        return ids
    new = np.concatenate([[True], ids[1:] != ids[:-1]])
    nth = np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    return np.where(nth == 0, ids, (mix(ids + nth.astype(np.uint64) * np.uint64(1 << 48)) | np.uint64(1 << 63)))


def _block_links(left: list[np.ndarray], right: list[np.ndarray] | None, idf: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked texts, of left and right or within left; a spanning forest of the links is enough."""
    every = left + (right or [])
    items = [jaccard_items(x) for x in every]
    weights = np.concatenate([idf[_cells(x)] for x in every])
    flat = np.concatenate(items)
    doc = np.repeat(np.arange(len(every)), [len(x) for x in items])
    total = np.bincount(doc, weights, minlength=len(every))
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    used, code = np.unique(code[shared], return_inverse=True)
    doc, weights = doc[shared], weights[shared]
    n, cut = len(every), len(left)
    common = np.zeros((cut, n - cut if right is not None else n))
    for first in range(0, len(used), 8192):  # a slice of the shared items at a time
        part = (code >= first) & (code < first + 8192)
        m = np.zeros((n, min(8192, len(used) - first)))
        m[doc[part], code[part] - first] = np.sqrt(weights[part])
        common += m[:cut] @ (m[cut:] if right is not None else m).T
    other = total[cut:] if right is not None else total
    union = total[:cut, None] + other[None, :] - common
    linked = common >= threshold * union * (1 - 1e-6)
    if right is None:
        linked &= np.tri(n, k=-1, dtype=bool)
    i, j = np.nonzero(linked)
    return i, j if right is None else j + cut


def links(items: DataFrame, bands: DataFrame, idf: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): representatives that are connected by links; items: (rep, ids binary), bands: (key, rep)."""
    spark = items.sparkSession
    weights = spark.sparkContext.broadcast(idf)
    sizes = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowd = join_counted(bands, sizes, ["key"], bands.count())
    few = crowd.where(F.col("n") <= SMALL)
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep"))).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    both = pairs.join(items.select(F.col("rep").alias("a"), F.col("ids").alias("ia")), "a").join(items.select(F.col("rep").alias("b"), F.col("ids").alias("ib")), "b")

    def verify(batches):
        for b in batches:
            ok = []
            for x, y in zip(column(b, "ia"), column(b, "ib"), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                ix, iy = jaccard_items(x), jaccard_items(y)
                wx, wy = weights.value[_cells(x)], weights.value[_cells(y)]
                common = wx[np.isin(ix, iy, assume_unique=True)].sum()
                ok.append(common >= threshold * (wx.sum() + wy.sum() - common) * (1 - 1e-6))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([column(b, "a").filter(keep), column(b, "b").filter(keep)], ["a", "b"])

    found = both.mapInArrow(verify, "a long, b long")

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    many = crowd.where(F.col("n") > SMALL).select("key", "rep", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("block"))
    meet = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "rep", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["block", "rep"])
        reps = frame.rep.to_numpy()
        ids = [np.frombuffer(v, np.uint64) for v in frame.ids]
        cut = int((frame.block == frame.low).sum())
        within = bool((frame.low == frame.high).all())
        i, j = _block_links(ids[:cut], None if within else ids[cut:], weights.value, threshold)
        moved, to = spanning_forest(i, j, len(ids))
        found = pd.DataFrame({"a": reps[to], "b": reps[moved]})
        release()  # what a block took goes back before other work of the executor needs it
        return found

    large = meet.join(items, "rep").groupBy("key", "low", "high").applyInPandas(block, "a long, b long")
    return found.unionByName(large)


def _row_key() -> list[F.Column]:
    """What tells the rows of one doc_id apart: 128 bits of the text."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


_ROW = ["doc_id", "t1", "t2"]


def members(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, t1, t2, class_id, copies, rows, stays) for each different row with an id and words.

    t1 and t2: hashes of the text; rows: how many rows are equal; stays: whether it is its class's first.
    """
    documents = documents.where("doc_id is not null and text is not null").select("doc_id", "text", *_row_key())
    bounded_batches(documents.sparkSession)
    idf = Idf(documents).idf
    shared = documents.sparkSession.sparkContext.broadcast(idf)

    def sign(batches):
        signer = Signer(shared.value)
        for b in steps(batches):
            words = Words(column(b, "text"))
            ids, tf, offsets = distinct_by_doc(*shingles(words))
            full = np.flatnonzero(np.diff(offsets) > 0)
            if not len(full):
                continue
            h = words.hashes()[words.codes]
            place = np.arange(len(h), dtype=np.uint64) - np.repeat(words.offsets[:-1], np.diff(words.offsets)).astype(np.uint64)
            starts = words.offsets[:-1][full]
            same = mix(np.add.reduceat(mix(h + mix(place)), starts)), mix(np.add.reduceat(mix(h ^ mix(place + np.uint64(1 << 40))), starts))
            keys = np.ascontiguousarray(signer.bands_of(ids, tf, offsets)).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            rows = [column(b, c).take(pa.array(full)) for c in _ROW]
            yield pa.RecordBatch.from_arrays([*rows, *(pa.array(x.view(np.int64)) for x in same), bands], [*_ROW, "rep", "same", "bands"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    signed = materialise(documents.mapInArrow(sign, f"doc_id {id_type}, t1 long, t2 long, rep long, same long, bands array<long>"), "neardup-signed")
    reps = materialise(signed.groupBy("rep", "same").agg(F.min(F.struct(*_ROW)).alias("first"), F.first("bands").alias("bands"), F.count("*").alias("copies")), "neardup-reps")
    bands = materialise(reps.select("rep", F.explode("bands").alias("key")), "neardup-bands")
    crowded = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    near = reps.join(bands.join(crowded, "key").select("rep").distinct(), "rep").select("rep", "first.*")

    def pack(batches):
        for b in steps(batches):
            ids, offsets = _features(*distinct_by_doc(*shingles(Words(column(b, "text")))))
            yield pa.RecordBatch.from_arrays([column(b, "rep"), binary_lists(ids, offsets)], ["rep", "ids"])

    # equal rows give equal items
    items = materialise(documents.join(near, _ROW).select("rep", "text").mapInArrow(pack, "rep long, ids binary").groupBy("rep").agg(F.max("ids").alias("ids")), "neardup-items")
    label = components(links(items, bands, idf, threshold))
    rows = signed.groupBy(*_ROW).agg(F.count("*").alias("rows"), F.first("rep").alias("rep"), F.first("same").alias("same"))
    # rows of a class that has links meet under its label; the others under their own text
    labelled = reps.select("rep", "same", "first", "copies").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    heads = labelled.where("label is not null").groupBy("label").agg(F.min("first").alias("head"))
    # rows with the same words are one representative, of any number of rows
    whole = materialise(labelled.join(heads, "label", "left").select("rep", "same", F.coalesce("head", "first").alias("head"), "copies", F.col("copies").alias("n")), "neardup-heads")
    return join_counted(rows, whole, ["rep", "same"], signed.count()).select(*_ROW, F.col("head.doc_id").alias("class_id"), "copies", "rows", (F.struct(*_ROW) == F.col("head")).alias("stays"))


def classes(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, copies): a row for each row of documents; copies: rows with the same words."""
    found = members(documents, threshold).select(*_ROW, "class_id", "copies")
    rows = documents.select("doc_id", *_row_key(), F.col("text").isNotNull().alias("_text"))
    return rows.join(found, _ROW, "left").select("doc_id", F.coalesce(F.when(F.col("_text"), F.col("class_id")), "doc_id").alias("class_id"), F.coalesce(F.when(F.col("_text"), F.col("copies")), F.lit(1)).alias("copies"))


def keep_first(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without near-duplicates: of each class the first row by id (and hash of the text) stays, once."""
    names = documents.columns
    found = materialise(members(documents, threshold).where("not stays or rows > 1").select(*_ROW, "stays", "rows"), "neardup-gone")
    # the rows are carried as one value, so that no column of theirs clashes
    keyed = documents.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_whole"), "doc_id", *_row_key(), F.col("text").isNotNull().alias("_text"))
    clear = keyed.join(found.select(*_ROW, F.lit(True).alias("_text")), [*_ROW, "_text"], "left_anti").select("_whole.*")
    once = keyed.where("_text").join(found.where("stays"), _ROW).dropDuplicates(_ROW).select("_whole.*")
    return clear.unionByName(once)


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class."""
    return classes(table(spark, sf_dir, "documents"))
