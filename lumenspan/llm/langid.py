"""Language identification by mixtures: each document's languages and their shares.

Each language has a model of hashed character n-grams (1 to 4 characters, word
ends included). A word's likelihood under a language is the product over its
n-grams, which overlap, to the power 1 / OVERLAP; a document draws each word from
one of its languages. Expectation-maximisation estimates the shares of all
languages, until none of a document moves by more than CONVERGED; of the sets that
drop the weakest language one at a time, each climbed to convergence, the one with
the highest penalised log-likelihood (PENALTY a language) is kept: `languages`, the
largest share first. The prediction is the first of them, the score is its share.

The labelled languages are few: the driver gets BUCKETS counts of each.

Defined results: null texts and texts without a letter are `und` with score 0 and no
languages, as are all if nothing was learned (an empty table too); very long texts
are read whole, as one step; ties go to the language that sorts first; rows are
judged one by one, and equal rows learned from as often as they occur; rows with a
null lang or text are not learned from; other columns are kept, but for earlier ones
named languages, lang_pred or score, which are replaced.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, bounded_batches, column, hash_unit, held_out, steps, table

#: Texts of each language that are learned from, at most (in expectation; taken by a hash of id and text).
SAMPLE_PER_LANGUAGE = 2_000
BUCKETS = 1 << 16
#: Bytes of text of a step: each distinct word is some forty n-grams.
STEP = 1_000_000
#: Each character lies in n-grams of four sizes, which repeat each other in part.
OVERLAP = 2.5
CONVERGED = 1e-3
PENALTY = 6.0
#: The least likelihood of a word under a language, relative to the best one's: a few odd characters exclude nothing.
FLOOR = 1e-7


def _ngrams(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word and bucket of each n-gram of each distinct word, over bytes."""
    raw = distinct.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.empty(0, np.uint8)
    n = np.diff(ends)
    # each word with a space before and after it
    word = np.repeat(np.arange(len(n)), n + 2)
    flat = np.full(int((n + 2).sum()), 32, np.uint64)
    place = np.repeat(np.arange(len(n)) * 2 + 1 - ends[0], n) + np.arange(ends[0], ends[-1])
    flat[place] = data[ends[0] : ends[-1]]
    words, keys = [], []
    key = np.zeros(len(flat), np.uint64)
    for size in range(1, 5):
        if size > len(flat):
            break
        key = key[: len(flat) - size + 1] * np.uint64(257) + flat[size - 1 :] + np.uint64(1)
        inside = word[: len(key)] == word[size - 1 :]
        words.append(word[: len(key)][inside])
        keys.append((((key[inside] + np.uint64(size << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64))
    return (np.concatenate(words), np.concatenate(keys)) if words else (np.empty(0, np.int64), np.empty(0, np.int64))


def has_letter(text: F.Column) -> F.Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


class Model:
    """Log-probability of each bucket under each language, over the mean of all languages."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: language by bucket."""
        self.languages = languages
        p = (counts + 0.05) / (counts + 0.05).sum(1, keepdims=True)
        self.logp = (np.log(p) - np.log(p).mean(0)).T.astype(np.float32)

    def word_likelihoods(self, distinct: pa.Array) -> np.ndarray:
        """Relative likelihood of each distinct word under each language (the best one's is 1)."""
        words, keys = _ngrams(distinct)
        total = np.stack([np.bincount(words, self.logp[keys, k], minlength=len(distinct)) for k in range(len(self.languages))], 1) / OVERLAP
        return np.maximum(np.exp(total - total.max(1, keepdims=True, initial=-np.inf)), FLOOR) if len(distinct) else np.empty((0, len(self.languages)))

    def mixtures(self, words: Words) -> np.ndarray:
        """The shares of the chosen languages of each text; zeros for texts without words."""
        docs, count = len(words.offsets) - 1, len(self.languages)
        shares = np.zeros((docs, count))
        n = np.diff(words.offsets)
        some = np.flatnonzero(n > 0)
        if not len(some):
            return shares
        like = self.word_likelihoods(words.distinct).astype(np.float32)
        # equal words of a text are one unit with a weight
        key, weight = np.unique(words.docs * len(words.distinct) + words.codes, return_counts=True)
        doc, code = key // len(words.distinct), key % len(words.distinct)
        like, weight = like[code], weight.astype(np.float32)
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        unit = np.cumsum(np.concatenate([[False], doc[1:] != doc[:-1]]))
        size = n[some][:, None].astype(np.float32)

        def climb(pi: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            pi = np.where(allowed, pi, 0)
            pi /= pi.sum(1, keepdims=True)
            at, like_at, weight_at, unit_at, starts_at = np.flatnonzero(allowed.sum(1) > 1), like, weight, unit, starts
            if len(at) < len(pi):
                at = np.empty(0, np.int64)  # one language each: nothing to climb
            while len(at):
                mix = like_at * pi[at].astype(np.float32)[unit_at]
                mix *= (weight_at / np.maximum(mix.sum(1), 1e-30))[:, None]
                new = np.add.reduceat(mix, starts_at, axis=0) / size[at]
                moving = np.abs(new - pi[at]).max(1) > CONVERGED
                pi[at] = new
                if moving.mean() < 0.7:  # go on with the documents that still move
                    keep = moving[unit_at]
                    at, like_at, weight_at, unit_at = at[moving], like_at[keep], weight_at[keep], (np.cumsum(moving) - 1)[unit_at[keep]]
                    starts_at = np.searchsorted(unit_at, np.arange(len(at)))
            total = np.log(np.maximum((like * pi[unit].astype(np.float32)).sum(1), 1e-30)) * weight
            return pi, np.add.reduceat(total.astype(float), starts)

        allowed = np.ones((len(some), count), bool)
        pi, ll = climb(np.full((len(some), count), 1.0 / count), allowed)
        best, best_value = pi, ll - PENALTY * count
        for left in range(count - 1, 0, -1):
            weakest = np.where(allowed, pi, np.inf).argmin(1)
            allowed = allowed.copy()
            allowed[np.arange(len(some)), weakest] = False
            pi, ll = climb(np.maximum(pi, 1e-3), allowed)
            value = ll - PENALTY * left
            better = value >= best_value
            best = np.where(better[:, None], pi, best)
            best_value = np.where(better, value, best_value)
        shares[some] = best
        return shares


def _count(batches):
    total: dict[str, np.ndarray] = {}
    for b in steps(batches, most=STEP):
        words = Words(column(b, "text"))
        word, key = _ngrams(words.distinct)
        langs = np.array(column(b, "lang").to_pylist(), dtype=object)
        for lang in set(langs.tolist()):
            used = np.bincount(words.codes[(langs == lang)[words.docs]], minlength=len(words.distinct))
            total.setdefault(lang, np.zeros(BUCKETS))
            total[lang] += np.bincount(key, used[word], minlength=BUCKETS)
    for lang, n in total.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some].astype(np.int64))], ["lang", "bucket", "n"])


def fit(documents: DataFrame, train: F.Column, per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """The model of texts and their lang where `train` holds (a condition on doc_id), a bounded sample of each language."""
    bounded_batches(documents.sparkSession)
    rows = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & train)
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not n:
        return None
    share = F.lit(1.0)
    for lang, count in n.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / count))).otherwise(share)
    counted = rows.where(hash_unit(F.xxhash64("doc_id", "text"), 21) < share).select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(counted.lang))  # those of texts that hold a word
    if not languages:
        return None
    counts = np.zeros((len(languages), BUCKETS))
    counts[[languages.index(x) for x in counted.lang], counted.bucket] = counted.n
    return Model(languages, counts)


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """All columns of documents, with lang_pred, score and languages (the chosen set, the largest share first)."""
    kept = documents.drop("lang_pred", "score", "languages")
    none = F.array().cast("array<string>")
    if model is None:
        return kept.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "languages": none})
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    names = kept.columns

    def run(batches):
        m = pickle.loads(shared.value)
        for b in steps(batches, most=STEP):
            shares = m.mixtures(Words(column(b, "text")))
            best = shares.argmax(1)
            score = np.clip(shares[np.arange(len(best)), best], 0, 1).astype(float)
            lang = pa.array(m.languages).take(pa.array(best))
            order = np.argsort(-shares, axis=1, kind="stable")
            ends = np.concatenate([[0], np.cumsum((shares > 0).sum(1))]).astype(np.int32)
            chosen = order[np.take_along_axis(shares, order, 1) > 0]
            sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(m.languages).take(pa.array(chosen)))
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in names), lang, pa.array(score), sets], [*names, "lang_pred", "score", "languages"])

    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StringType()))])
    out = kept.mapInArrow(run, schema)
    letter = has_letter(F.col("text"))
    return out.withColumns({"lang_pred": F.when(letter, F.col("lang_pred")).otherwise("und"), "score": F.when(letter, F.col("score")).otherwise(0.0), "languages": F.when(letter, F.col("languages")).otherwise(none)})


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; learned outside the held-out quarter."""
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, ~held_out(F.col("doc_id"), 4))
    out = predict(documents.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score", F.array_join("languages", ",").alias("languages"))
