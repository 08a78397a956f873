"""Toxicity by class-conditional Kneser-Ney models.

Two word models, of toxic and of ordinary texts, share their lowest backoff level:

    P_c(w | h) = (n_c(h w) - D(n)) / n_c(h .) + back_c(h) * P_c(w)  n: distinct surroundings of h w
    P_c(w)     = (k_c(w) - D(k)) / K_c + back_c * P(w)              k: distinct words before w
    P(w)       = (k(w) + 1) / (K + V + 1)                           k: classes that have w

with DISCOUNTS for counts of 1, 2 and more, and back_c what the discounts of a class leave.

The highest level counts the different surroundings (the words before and after) that
a pair has, so that a passage that copies or near copies repeat counts once; the next
one counts left contexts, as Kneser-Ney does; the shared one holds rare expressions of
either class alike, however often one class repeats them. Pairs of fewer than
PAIR_PLACES surroundings in either class are left to the lower levels, and back_c(h)
takes all mass that the kept pairs leave, so each model sums to 1 over all words and
the unknown word.

A text is compared by two length-normalised log-likelihood ratios: that of the whole
text, and that of its strongest passage of PASSAGE words in a row (the whole of a
shorter text; a word that it repeats counts once), as a few expressions make a long
text toxic. The strongest of many passages is stronger by chance, about as the
logarithm of their number, which is therefore set beside the ratios. A logistic
calibration, fitted on labelled texts that the counts did not see, turns all three
into a score; the share of toxic texts that it assumes is that of the training labels.

Defined results: null and empty texts have no words, so all three are 0 and their
score is the calibration's there; very long texts are read whole, as one step; rows
are scored one by one, so ties and repeated rows don't matter, and equal rows are
learned from once; labels of a null id, or neither 0 nor 1, are ignored, and an id
with both labels counts as toxic; with no labelled row of one class (empty tables
too), all scores are 0; where the calibration sees one class only, the strongest
passage alone decides, by fixed weights; other columns are kept, but for earlier ones named score or
predicted, which are replaced.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, bounded_batches, column, hash_unit, held_out, materialise, mix, steps, table

#: Labelled rows and characters of each class that are learned from, at most (in expectation; taken by a hash of id and text).
SAMPLE_PER_CLASS, SAMPLE_CHARACTERS = 6_000, 20_000_000
PASSAGE = 4
#: Both ratios and the logarithm of the number of passages.
FEATURES = 3
#: What is taken off a count of 1, of 2 and of more, for the level below.
DISCOUNTS = (1.0, 1.5, 2.0)
#: A pair of words counts as an expression from so many different surroundings in one class.
PAIR_PLACES = 8
PUNCTUATION = " .,;:!?\"'()[]{}<>|*_-"
_BOS, _EOS = np.uint64(0x5EED), np.uint64(0xE05)


def word_hashes(words: Words) -> np.ndarray:
    """A hash for each word of a batch, without the punctuation around it."""
    return words.hashes(pc.utf8_trim(words.distinct, PUNCTUATION))[words.codes]


def _pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + w)


def _previous(w: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.empty_like(w)
    out[1:] = w[:-1]
    out[offsets[:-1][np.diff(offsets) > 0]] = _BOS
    return out


def _pairs(batches):
    """(cls, h, w, e): the pair h w in a text of the class, and a hash of the words before and after it."""
    for b in steps(batches):
        words = Words(column(b, "text"))
        w = word_hashes(words)
        if not len(w):
            continue
        h = _previous(w, words.offsets)
        after = np.append(w[1:], _EOS)
        after[words.offsets[1:][np.diff(words.offsets) > 0] - 1] = _EOS
        e = _pair(_previous(h, words.offsets), after)
        cls = column(b, "toxic").to_numpy(zero_copy_only=False).astype(np.int32)[words.docs]
        _, first = np.unique(_pair(_pair(h, w), e) + cls.astype(np.uint64), return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(cls[first]), *(pa.array(x[first].view(np.int64)) for x in (h, w, e))], ["cls", "h", "w", "e"])


def labelled_sample(documents: DataFrame, labels: DataFrame, train: F.Column, per_class: int, characters: int) -> tuple[DataFrame, float]:
    """(doc_id, t1, t2, text, toxic, calibration) of a bounded sample of each class, and the share of toxic ids.

    The ids that may be taken are bounded by a hash of the id and broadcast; of their different rows (one id may
    have any number) a hash of id and text takes about per_class, of about so many characters in all.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(train)
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.lit(0.0)
    for cls, n in counts.items():
        share = F.when(F.col("toxic") == cls, F.lit(min(1.0, per_class / n))).otherwise(share)
    chosen = known.where(hash_unit(F.col("doc_id"), 11) < share).select("doc_id", "toxic")
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", "text", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")).join(F.broadcast(chosen), "doc_id")
    sizes = rows.groupBy("doc_id", "t1", "t2", "toxic").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("size")).groupBy("toxic").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("toxic") == r["toxic"], F.lit(min(1.0, per_class / r["n"], characters / max(1, r["size"])))).otherwise(share)
    row = F.xxhash64("doc_id", "t1")
    taken = rows.where(hash_unit(row, 13) < share).dropDuplicates(["doc_id", "t1", "t2"])
    return taken.withColumn("calibration", hash_unit(row, 12) < 0.25), counts.get(1, 0) / max(1, sum(counts.values()))


class Model:
    """Sorted hashes with a log-ratio (toxic to ordinary) for each, looked up by binary search."""

    def __init__(self, unseen: float, words: tuple[np.ndarray, np.ndarray], contexts: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray]):
        """words: P(w); contexts: back(h), of contexts that have a kept pair; pairs: P(w | h) by the hash of the pair."""
        self.unseen = unseen
        (self.words, self.uni), (self.contexts, self.back), (self.pairs, self.pair) = (self._sorted(*x) for x in (words, contexts, pairs))
        self.weights = np.zeros(FEATURES + 1)

    @staticmethod
    def _sorted(keys: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        return keys[order], ratio[order]

    @staticmethod
    def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return at, keys[at] == x

    def _of(self, keys: np.ndarray, ratio: np.ndarray, x: np.ndarray, other: float) -> np.ndarray:
        at, found = self._find(keys, x)
        return np.where(found, ratio[at], other) if len(keys) else np.full(len(x), other)

    def word_ratios(self, words: Words) -> np.ndarray:
        """The log-likelihood ratio of each word of a batch, given the word before it."""
        distinct = words.hashes(pc.utf8_trim(words.distinct, PUNCTUATION))
        uni = self._of(self.words, self.uni, distinct, self.unseen)
        back = self._of(self.contexts, self.back, distinct, 0.0)
        w = distinct[words.codes]
        r = uni[words.codes]
        r[1:] += back[words.codes[:-1]]
        first = words.offsets[:-1][np.diff(words.offsets) > 0]
        r[first] = uni[words.codes[first]] + self._of(self.contexts, self.back, np.array([_BOS]), 0.0)[0]
        at, hit = self._find(self.pairs, _pair(_previous(w, words.offsets), w))
        if hit.any():
            r[hit] = self.pair[at[hit]]
        return r

    def ratios(self, words: Words) -> np.ndarray:
        """For each text: log-likelihood ratio a word of the whole, and of its strongest passage; logarithm of the number of passages."""
        docs = len(words.offsets) - 1
        out = np.zeros((docs, FEATURES))
        if not len(words.codes):
            return out
        r = self.word_ratios(words)
        total = np.concatenate([[0], np.cumsum(r)])
        n = np.diff(words.offsets)
        some = np.flatnonzero(n > 0)
        out[some, 0] = (total[words.offsets[1:]] - total[words.offsets[:-1]])[some] / n[some]
        w = word_hashes(words)
        for back in range(1, PASSAGE):
            again = w[back:] == w[:-back]
            r[back:][again & (words.docs[back:] == words.docs[:-back])] = 0
        total = np.concatenate([[0], np.cumsum(r)])
        # the passage that ends at each word; one that would begin before its text ends further on
        begin = np.repeat(words.offsets[:-1], n)
        length = np.minimum(PASSAGE, np.repeat(n, n))
        end = np.maximum(np.arange(1, len(begin) + 1), begin + length)
        out[some, 1] = np.maximum.reduceat((total[end] - total[end - length]) / length, words.offsets[:-1][some])
        out[some, 2] = np.log(np.maximum(1, n[some] - PASSAGE + 1))
        return out

    def scores(self, ratios: np.ndarray) -> np.ndarray:
        x = ratios @ self.weights[:FEATURES] + self.weights[FEATURES]
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def calibrate(self, ratios: np.ndarray, y: np.ndarray, share: float) -> None:
        """Ridge logistic regression by Newton steps; share: of toxic rows among all labelled."""
        x = np.column_stack([ratios, np.ones(len(y))])
        weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
        penalty = np.diag([*[0.05] * FEATURES, 1e-3])
        b = np.zeros(FEATURES + 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            grad = x.T @ (weight * (y - p)) - penalty @ b
            step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + penalty, grad)
            b += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        self.weights = b


def _discount(n: str) -> F.Column:
    one, two, more = DISCOUNTS
    return F.when(F.col(n) == 0, 0.0).when(F.col(n) == 1, one).when(F.col(n) == 2, two).otherwise(more)


def _arrays(df: DataFrame) -> list[np.ndarray]:
    return [c.to_numpy() for c in df.toArrow().columns]


def count(rows: DataFrame) -> Model | None:
    """The log-ratios of all words, contexts and kept pairs of (toxic, t1, t2, text); the driver gets no counts."""
    texts = rows.dropDuplicates(["toxic", "t1", "t2"]).select("text", "toxic")
    n = lambda c: F.sum((F.col("cls") == c).cast("int")).alias(f"n{c}")
    pairs = materialise(texts.mapInArrow(_pairs, "cls int, h long, w long, e long").distinct().groupBy("h", "w").agg(n(0), n(1)), "toxicity-pairs")
    some = lambda c: F.sum((F.col(f"n{c}") > 0).cast("int")).alias(f"k{c}")
    words = pairs.groupBy("w").agg(some(0), some(1))
    by_class = [F.sum(x(f"k{c}")).alias(f"{name}{c}") for c in (0, 1) for name, x in (("k", F.col), ("off", _discount), ("t", lambda k: (F.col(k) > 0).cast("int")))]
    sums = words.agg(*by_class, F.count("*").alias("v")).first().asDict()
    if not sums["k0"] or not sums["k1"]:
        return None
    left = [sums[f"off{c}"] / sums[f"k{c}"] for c in (0, 1)]
    every = float(sums["t0"] + sums["t1"] + sums["v"] + 1)
    shared = ((F.col("k0") > 0).cast("int") + (F.col("k1") > 0).cast("int") + 1) / every
    p = [((F.col(f"k{c}") - _discount(f"k{c}")) / float(sums[f"k{c}"]) + left[c] * shared).alias(f"p{c}") for c in (0, 1)]
    words = words.select("w", *p)
    kept = F.greatest("n0", "n1") >= PAIR_PLACES
    over = [F.col(f"n{c}") - _discount(f"n{c}") for c in (0, 1)]
    back = [F.when(F.sum(f"n{c}") > 0, 1 - F.sum(F.when(kept, over[c]).otherwise(0.0)) / F.sum(f"n{c}")).otherwise(1.0).alias(f"b{c}") for c in (0, 1)]
    contexts = materialise(pairs.groupBy("h").agg(*back, F.sum("n0").alias("all0"), F.sum("n1").alias("all1"), F.max(kept).alias("kept")).where("kept"), "toxicity-contexts")
    often = pairs.where(kept).join(words, "w").join(contexts, "h")
    full = [over[c] / F.greatest(F.col(f"all{c}"), F.lit(1)) + F.col(f"b{c}") * F.col(f"p{c}") for c in (0, 1)]
    key, ratio = _arrays(words.select("w", F.ln(F.col("p1") / F.col("p0"))))
    h, turned = _arrays(contexts.select("h", F.ln(F.col("b1") / F.col("b0"))))
    first, second, pair = _arrays(often.select("h", "w", F.ln(full[1] / full[0])))
    as_keys = lambda x: x.view(np.uint64)
    return Model(float(np.log(left[1] / left[0])), (as_keys(key), ratio), (as_keys(h), turned), (_pair(as_keys(first), as_keys(second)), pair))


def fit(documents: DataFrame, labels: DataFrame, train: F.Column, per_class: int = SAMPLE_PER_CLASS, characters: int = SAMPLE_CHARACTERS) -> Model | None:
    """The model of the labelled rows for which `train` holds (a condition on doc_id), a bounded sample of each class."""
    bounded_batches(documents.sparkSession)
    taken, toxic = labelled_sample(documents, labels, train, per_class, characters)
    rows = materialise(taken, "toxicity-sample")
    model = count(rows.where(~F.col("calibration")))
    if model is None:
        return None
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def measure(batches):
        m = pickle.loads(shared.value)
        for b in steps(batches):
            r = m.ratios(Words(column(b, "text")))
            yield pa.RecordBatch.from_arrays([column(b, "toxic"), *(pa.array(r[:, i]) for i in range(FEATURES))], ["toxic", *"abc"])

    seen = rows.where("calibration").select("text", "toxic").mapInArrow(measure, "toxic int, a double, b double, c double").toPandas()
    if seen.toxic.nunique() == 2:
        model.calibrate(seen[["a", "b", "c"]].to_numpy(), seen.toxic.to_numpy(), toxic)
    else:
        model.weights = np.array([0.0, 2.0, 0.0, -3.0])
    return model


def score(documents: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """All columns of documents, with score and predicted (1 if score >= threshold); columns of those names are replaced."""
    kept = documents.drop("score", "predicted")
    if model is None:
        return kept.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    names = kept.columns

    def run(batches):
        m = pickle.loads(shared.value)
        for b in steps(batches):
            s = m.scores(m.ratios(Words(column(b, "text"))))
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in names), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return kept.mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; learned from labelled rows outside the held-out quarter."""
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 4))
    out = score(documents.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", "predicted")
