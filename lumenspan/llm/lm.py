"""Language-model scoring by a weighted backoff automaton of words, pairs and triples.

Counts of all training tokens (words and one end a text; two begins stand before it) give the model:

    p(w)       = (c(w) - D) / N,  D V / N for all unknown words together
    p(w | s)   = (c(s w) - D) / c(s) + back(s) p(w | t)  for kept s w, else back(s) p(w | t)
    back(s)    = 1 - sum of (c(s w) - D) / c(s) over kept s w,  so every state's arcs sum to 1

States s are the root, words, and pairs of words; t is s without its first word. All pairs and triples that
occur `least` times are kept, whatever the size of the input (1 keeps all). In the automaton a kept s w is an arc of
state s, of weight log p(w | s), to the longest state that s w ends in; the failure arc of s, of weight log back(s),
leads to t. A text is read once from left to right with one state in hand: each word takes failure arcs until the
state has an arc for it, adds up their weights and goes on from the arc's end. Texts are read in step, many at a time,
long ones in stretches of STRETCH words; as a state tells of two words at most, a stretch that begins two words
earlier at the root is in the right state when its own words come.

The counts are one table over Spark, which grows with the input: n-grams are 64-bit hashes, cut into buckets by
range and kept as packed arrays, about GRAMS training n-grams a bucket. A task sums its own n-grams before the
shuffle, so a frequent one arrives once from each task. A pair can only be kept if its words occur `least` times, and
a triple if its pairs do; filters of 2^FILTER_BITS bits (of fixed size, and never wrong about what is kept) leave
most others out before they are shuffled.

Scoring cuts the texts into blocks of about BLOCK bytes. A block asks each bucket once for the n-grams that it
holds, however often, gets counts and masses of those that are kept, and so has the part of the automaton that its
texts walk. Blocks pass in WAVES, which bounds what lies on disk at a time.

As for base_score, all unknown words are one event. Defined results: null texts are empty, that is an end alone;
texts of any length are read whole (one beyond BLOCK is a block of its own); repeated rows are counted and returned
one by one; other columns of documents are not looked at; with nothing to learn from (an empty table too), N is 0
and all scores are 0 (no model).
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, bounded_batches, column, held_out, materialise, mix, release, shared_path, shuffles_freed, sorted_distinct, steps, table

#: Taken off every kept count, and the occurrences from which pairs and triples are kept: defaults of train().
DISCOUNT, LEAST = 0.6, 2
#: Words of a stretch that is read in step with others.
STRETCH = 64
#: Training n-grams of a bucket and bytes of text of a block, about; parts in which the blocks pass.
GRAMS, BLOCK, WAVES = 6_000_000, 16_000_000, 6
#: n-grams that a task sums before it hands them over.
HELD = 4_000_000
FILTER_BITS = 26
# strings that no word is, as they hold white space
_END, _BEGIN = Words.hashes(None, pa.array(["\n", "\n\n"]))
_ODD = np.uint64(0x9E3779B97F4A7C15)
GRAMS_SCHEMA = "bucket int, keys binary, before binary, n binary"
TABLE_SCHEMA = "bucket int, keys binary, c binary, mass binary, bits binary, total long"


def _longer(state: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The key of a state's n-gram with one more word."""
    return mix(state * _ODD + w)


_BEGINS = _longer(np.array([_BEGIN]), np.array([_BEGIN]))[0]


class Tokens:
    """The words of some texts with each text's end: keys of the word, pair and triple at each, and of the states before it."""

    def __init__(self, texts: pa.Array):
        words = Words(texts, ascii_only=True)
        self.distinct = np.append(words.hashes(), _END)
        n = np.diff(words.offsets)
        self.starts = words.offsets[:-1] + np.arange(len(n))
        self.size = n + 1
        self.codes = np.full(len(words.codes) + len(n), len(self.distinct) - 1, np.int64)
        self.codes[np.arange(len(words.codes)) + words.docs] = words.codes

    @functools.cached_property
    def w(self) -> np.ndarray:
        return self.distinct[self.codes]

    @functools.cached_property
    def word_state(self) -> np.ndarray:
        return self._before(self.w, _BEGIN)

    @functools.cached_property
    def pair(self) -> np.ndarray:
        return _longer(self.word_state, self.w)

    @functools.cached_property
    def pair_state(self) -> np.ndarray:
        return self._before(self.pair, _BEGINS)

    @functools.cached_property
    def triple(self) -> np.ndarray:
        return _longer(self.pair_state, self.w)

    def _before(self, x: np.ndarray, first: np.uint64) -> np.ndarray:
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.starts] = first
        return out


class Filter:
    """One bit for each of 2^FILTER_BITS ranges of keys: whether a kept key may lie in it."""

    def __init__(self, rows: DataFrame, buckets: int):
        """rows: (bucket, bits) of those buckets that hold n-grams; each has its part of the bits."""
        self.bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        size = len(self.bits) // buckets
        for r in rows.where("bits is not null").select("bucket", "bits").collect():  # 2^FILTER_BITS bits in all
            self.bits[r["bucket"] * size : (r["bucket"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)

    @staticmethod
    def of(keys: np.ndarray, bucket: int, buckets: int) -> bytes:
        size = (1 << FILTER_BITS) // buckets
        bits = np.zeros(size, bool)
        bits[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64) - bucket * size] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        cell = keys >> np.uint64(64 - FILTER_BITS)
        return (self.bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _bounds(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted keys fall into, and where each begins (with the end)."""
    bucket = (keys >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64) if buckets > 1 else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.empty(0, np.int64)
    return bucket[cuts], np.append(cuts, len(keys))


def _dealt(buckets: int, keys: np.ndarray, *values: np.ndarray) -> list[list]:
    """bucket, and the bytes of keys and values in it, as columns; keys are sorted."""
    bucket, cuts = _bounds(keys, buckets)
    return [bucket.tolist(), *([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] for x in (keys, *values))]


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(np.frombuffer(x, kind) for x in column.to_pylist() if x)])


def _arrow(schema: str, columns: list[list]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array(values, kinds[kind]) for (name, kind), values in zip(fields, columns, strict=True)})


def _counts(texts: DataFrame, order: int, buckets: int, words=None, pairs=None) -> DataFrame:
    """The n-grams of an order, summed by task: GRAMS_SCHEMA, with the state before each (none for words)."""

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def summed():
            keys, before, n = (np.concatenate(x) for x in zip(*held, strict=True))
            sort = np.argsort(keys)
            keys = keys[sort]
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            n = np.add.reduceat(n[sort], new).astype(np.uint32)
            before = before[sort[new]] if order > 1 else np.empty(0, np.uint64)
            held.clear()
            rows = _dealt(buckets, keys[new], n, *([before] if order > 1 else []))
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[3] if order > 1 else [None] * len(rows[0]), pa.binary()), pa.array(rows[2], pa.binary())], ["bucket", "keys", "before", "n"])

        for b in steps(batches):
            t = Tokens(column(b, "text"))
            if order == 1:
                n = np.bincount(t.codes, minlength=len(t.distinct))
                held.append((t.distinct[n > 0], np.empty(0, np.uint64), n[n > 0].astype(np.uint32)))
            else:
                if order == 2:
                    known = words.value.may_have(t.distinct)[t.codes]
                    ok = known.copy()
                    ok[1:] &= known[:-1]
                    ok[t.starts] = known[t.starts]
                    key, before = t.pair, t.word_state
                else:
                    known = pairs.value.may_have(t.pair)
                    ok = known.copy()
                    ok[1:] &= known[:-1]
                    ok[t.starts] = known[t.starts]
                    key, before = t.triple, t.pair_state
                held.append((key[ok], before[ok], np.ones(int(ok.sum()), np.uint32)))
            size += len(held[-1][0])
            if size > HELD:
                yield summed()
                size = 0
        if size:
            yield summed()
        release()

    return texts.mapInArrow(run, GRAMS_SCHEMA)


def _table(texts: DataFrame, order: int, buckets: int, discount: float, fewest: int, words=None, pairs=None) -> DataFrame:
    """The kept n-grams of an order by bucket, with their counts, and the masses that their states give them."""
    least = fewest if order > 1 else 1

    def total(rows: pa.Table) -> pa.Table:
        bucket = rows["bucket"][0].as_py()
        keys, n = _joined(rows["keys"], np.uint64), _joined(rows["n"], np.uint32)
        sort = np.argsort(keys)
        keys = keys[sort]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.add.reduceat(n[sort].astype(np.int64), new)
        kept = n >= least
        c, often = n[kept], n[kept] >= fewest
        columns = [[bucket], [keys[new][kept].tobytes()], [c.astype(float).tobytes()], [None], [Filter.of(keys[new][kept][often], bucket, buckets)], [int(n.sum())]]
        if order > 1:
            before = _joined(rows["before"], np.uint64)[sort[new[kept]]]
            state, where = np.unique(before, return_inverse=True)
            to, states, masses = _dealt(buckets, state, np.bincount(where, c - discount, minlength=len(state)))
            none = [None] * len(to)
            columns = [a + b for a, b in zip(columns, [to, states, none, masses, none, none], strict=True)]
        out = _arrow(TABLE_SCHEMA, columns)
        del keys, n, sort, new, kept, c, often
        release()
        return out

    return materialise(_counts(texts, order, buckets, words, pairs).groupBy("bucket").applyInArrow(total, TABLE_SCHEMA), f"lm-{order}-grams")


class Model:
    """The table of all n-grams (rows of TABLE_SCHEMA), its sums, and the filters of what is kept (broadcast)."""

    def __init__(self, grams: DataFrame, buckets: int, tokens: int, vocabulary: int, texts: int, discount: float, pairs, triples):
        self.grams, self.buckets, self.tokens, self.vocabulary, self.texts, self.discount, self.pairs, self.triples = grams, buckets, tokens, vocabulary, texts, discount, pairs, triples


def train(documents: DataFrame, learn: F.Column, discount: float = DISCOUNT, least: int = LEAST) -> Model | None:
    """The model of the documents for which `learn` holds; None if there are none. least: occurrences from which pairs and triples are kept."""
    spark = documents.sparkSession
    bounded_batches(spark)
    texts = documents.where(learn).select("text")
    n_texts, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if not n_texts:
        return None
    # words have about six characters; a bucket takes n-grams of three orders
    buckets = 1 << min(FILTER_BITS - 3, max(4, math.ceil(math.log2(max(1.0, 3 * size / 6 / GRAMS)))))
    send = lambda rows: spark.sparkContext.broadcast(Filter(rows, buckets))
    words = _table(texts, 1, buckets, discount, least)
    tokens, vocabulary = words.agg(F.sum("total"), F.sum(F.length("keys") / 8).cast("long")).first()
    known = send(words)
    pairs = _table(texts, 2, buckets, discount, least, words=known)
    known.destroy()
    some = send(pairs)
    triples = _table(texts, 3, buckets, discount, least, pairs=some)
    grams = words.unionByName(pairs).unionByName(triples).select("bucket", "keys", "c", "mass")
    return Model(grams, buckets, int(tokens), int(vocabulary), int(n_texts), discount, some, send(triples))


def blocks(documents: DataFrame, size: int) -> DataFrame:
    """(block, doc_id, text): documents as they lie, in blocks of about so many bytes."""

    def run(batches):
        part, block, held = TaskContext.get().partitionId(), 0, 0
        for b in steps(batches, most=size):
            n = column(b, "text").nbytes
            if held and held + n > size:
                block, held = block + 1, 0
            held += n
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, (part << 32) | block)), column(b, "doc_id"), column(b, "text")], ["block", "doc_id", "text"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    path = shared_path(documents.sparkSession, "lm-blocks")
    documents.select("doc_id", "text").mapInArrow(run, f"block long, doc_id {id_type}, text string").write.option("compression", "zstd").parquet(path)
    return documents.sparkSession.read.parquet(path)


def _asked(texts: DataFrame, model: Model) -> DataFrame:
    """(bucket, block, keys): the n-grams of each block that may be kept, and its words."""
    pairs, triples, buckets = model.pairs, model.triples, model.buckets

    def run(batches):
        block, held, size = None, [], 0

        def asked():
            rows = _dealt(buckets, sorted_distinct(np.concatenate([*held, np.array([_BEGIN, _BEGINS])])))
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array([block] * len(rows[0]), pa.int64()), pa.array(rows[1], pa.binary())], ["bucket", "block", "keys"])

        for b in steps(batches):
            number = column(b, "block").to_numpy()
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1), len(number)]
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                if held and (number[first] != block or size > HELD):
                    yield asked()
                    held, size = [], 0
                block = int(number[first])
                t = Tokens(column(b, "text").slice(first, last - first))
                held.append(sorted_distinct(np.concatenate([t.distinct, t.pair[pairs.value.may_have(t.pair)], t.triple[triples.value.may_have(t.triple)]])))
                size += len(held[-1])
        if held:
            yield asked()

    return texts.select("block", "text").mapInArrow(run, "bucket int, block long, keys binary")


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def _answered(rows: pa.Table) -> pa.Table:
    """(block, keys, c, mass) for the rows of a bucket that ask, from those that hold n-grams."""
    asks = rows["block"].is_valid().to_numpy()
    holds = rows.filter(pa.array(~asks))
    keys, c, mass = [], [], []
    for k, n, m in zip(*(holds[x].to_pylist() for x in ("keys", "c", "mass")), strict=True):
        keys.append(np.frombuffer(k, np.uint64))
        c.append(np.frombuffer(n, float) if n else np.zeros(len(keys[-1])))
        mass.append(np.frombuffer(m, float) if m else np.zeros(len(keys[-1])))
    keys, where = np.unique(np.concatenate([np.empty(0, np.uint64), *keys]), return_inverse=True)
    c, mass = (np.bincount(where, np.concatenate([np.empty(0), *x]), minlength=len(keys)) for x in (c, mass))
    asking = rows.filter(pa.array(asks))
    out: list[list] = [[], [], [], []]
    for block, k in zip(asking["block"].to_pylist(), asking["keys"].to_pylist(), strict=True):
        k = np.frombuffer(k, np.uint64)
        at, found = _find(keys, k)
        for column_, value in zip(out, (block, k[found].tobytes(), c[at[found]].tobytes(), mass[at[found]].tobytes()), strict=True):
            column_.append(value)
    answers = _arrow("block long, keys binary, c binary, mass binary", out)
    del keys, c, mass, where, out
    release()
    return answers


class Grams:
    """The kept n-grams that the texts of a block can meet."""

    def __init__(self, answers: pa.Table, tokens: int, vocabulary: int, texts: int, discount: float):
        self.tokens, self.vocabulary, self.discount = tokens, vocabulary, discount
        keys, c, mass = _joined(answers["keys"], np.uint64), _joined(answers["c"], float), _joined(answers["mass"], float)
        self.keys, first = np.unique(keys, return_index=True)
        self.c, self.mass = c[first], mass[first]
        for begin in (_BEGIN, _BEGINS):  # as often as there are texts
            at, found = _find(self.keys, np.array([begin]))
            self.c[at[found]] = texts

    def look_up(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted n-grams: how often they occur (0 if not kept), and the mass of what follows them."""
        c, mass = np.zeros(len(x)), np.zeros(len(x))
        at, found = _find(self.keys, x)
        c[found], mass[found] = self.c[at[found]], self.mass[at[found]]
        return c, mass


class Automaton:
    """States and arcs for some texts.

    States are numbers: the root 0, the state of each of the texts' distinct words, those of one and of two begins, and
    of the distinct pairs. `lost` and `fail` are each state's failure arc (weight and end), `root` and `from_root` the
    root's arc for each word, and `arcs`, `weight` and `end` all others, sorted by state and word.
    """

    def __init__(self, t: Tokens, grams: Grams):
        words, d = len(t.distinct), grams.discount
        order = np.argsort(t.distinct)
        c, mass = np.zeros(words), np.zeros(words)
        c[order], mass[order] = grams.look_up(t.distinct[order])
        self.words, self.count, self.begin = words, c, words + 2
        p_root = np.where(c > 0, c - d, d * grams.vocabulary) / grams.tokens
        begins = np.array(sorted((int(_BEGIN), int(_BEGINS))), np.uint64)
        begin_c, begin_mass = (dict(zip(begins.tolist(), x.tolist(), strict=True)) for x in grams.look_up(begins))
        pair, first, which = np.unique(t.pair, return_index=True, return_inverse=True)
        pair_c, pair_mass = grams.look_up(pair)
        triple, at3 = np.unique(t.triple, return_index=True)
        triple_c = grams.look_up(triple)[0]
        seen = np.concatenate([[1.0], np.maximum(c, 1), [max(begin_c[int(b)], 1.0) for b in (_BEGIN, _BEGINS)], np.maximum(pair_c, 1)])
        back = 1 - np.concatenate([[0.0], mass, [begin_mass[int(b)] for b in (_BEGIN, _BEGINS)], pair_mass]) / seen
        self.lost = np.log10(back)
        self.fail = np.concatenate([np.zeros(words + 1, np.int64), [0, words + 1], 1 + t.codes[first]])
        # states before each place: of the last word, and of the last two
        word_state, pair_state = np.empty(len(t.codes), np.int64), np.empty(len(t.codes), np.int64)
        word_state[1:], pair_state[1:] = 1 + t.codes[:-1], words + 3 + which[:-1]
        word_state[t.starts], pair_state[t.starts] = words + 1, words + 2
        # an arc ends in the longest state with arcs of its own
        end_word = np.where(mass > 0, 1 + np.arange(words), 0)
        end_pair = np.where(pair_mass > 0, words + 3 + np.arange(len(pair)), end_word[t.codes[first]])
        self.root, self.from_root = np.log10(p_root), end_word
        p_pair = np.maximum(pair_c - d, 0) / seen[word_state[first]] + back[word_state[first]] * p_root[t.codes[first]]
        two, three = pair_c > 0, triple_c > 0
        i2, i3 = first[two], at3[three]
        p_triple = (triple_c[three] - d) / seen[pair_state[i3]] + back[pair_state[i3]] * p_pair[which[i3]]
        key = np.concatenate([word_state[i2] * words + t.codes[i2], pair_state[i3] * words + t.codes[i3]])
        sort = np.argsort(key)
        self.arcs = key[sort]
        self.weight = np.log10(np.concatenate([p_pair[two], p_triple]))[sort]
        self.end = np.concatenate([end_pair[two], end_pair[which[i3]]])[sort]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each state's next one by a word, and the weight of the arcs on the way."""
        state, weight, new = state.copy(), np.zeros(len(state)), np.empty(len(state), np.int64)
        open_ = np.arange(len(state))
        while len(open_):
            here = state[open_]
            root = here == 0
            done = open_[root]
            weight[done] += self.root[word[done]]
            new[done] = self.from_root[word[done]]
            open_, here = open_[~root], here[~root]
            at, found = _find(self.arcs, here * self.words + word[open_])
            done = open_[found]
            weight[done] += self.weight[at[found]]
            new[done] = self.end[at[found]]
            open_, here = open_[~found], here[~found]
            weight[open_] += self.lost[here]
            state[open_] = self.fail[here]
        return new, weight

    def traverse(self, t: Tokens, visit=None) -> np.ndarray:
        """The weight of each word; visit, if given, is called with (places, states before them)."""
        out = np.empty(len(t.codes))
        per = -(-t.size // STRETCH)
        text = np.repeat(np.arange(len(per)), per)
        own = t.starts[text] + STRETCH * (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per))
        stop = np.minimum(own + STRETCH, (t.starts + t.size)[text])
        at = np.maximum(own - 2, t.starts[text])
        state = np.where(at == t.starts[text], self.begin, 0)
        while len(at):
            if visit is not None:
                visit(at[at >= own], state[at >= own])
            state, weight = self.step(state, t.codes[at])
            mine = at >= own
            out[at[mine]] = weight[mine]
            at = at + 1
            on = at < stop
            at, own, stop, state = at[on], own[on], stop[on], state[on]
        return out

    def walk(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: words known, the sum of log10(c + 1), and the logarithm of its probability."""
        each = ((self.count > 0)[t.codes], np.log10(self.count + 1)[t.codes], self.traverse(t))
        return tuple(np.add.reduceat(x.astype(float), t.starts) for x in each)


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of documents."""
    rows = documents.select("doc_id", "text")
    if model is None:
        n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")) + 1
        return rows.select("doc_id", n.cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    spark = documents.sparkSession
    bounded_batches(spark)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    tokens, vocabulary, n_texts, discount = model.tokens, model.vocabulary, model.texts, model.discount

    def walk(texts: pa.Table, answers: pa.Table) -> pa.Table:
        grams = Grams(answers, tokens, vocabulary, n_texts, discount)
        out = []
        for b in steps(texts.to_batches()):
            t = Tokens(column(b, "text"))
            known, base, logp = Automaton(t, grams).walk(t)
            values = [column(b, "doc_id"), pa.array(t.size.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(b.num_rows, tokens)), pa.array(base - t.size * math.log10(tokens + vocabulary + 1)), pa.array(logp)]
            out.append(pa.RecordBatch.from_arrays(values, [f.split()[0] for f in schema.split(", ")]))
        del grams
        release()
        return pa.Table.from_batches(out)

    cut = blocks(rows, BLOCK)
    waves = max(1, min(WAVES, cut.select("block").distinct().count()))
    cut = cut.withColumn("wave", F.pmod(F.xxhash64("block"), F.lit(waves)))
    path = shared_path(spark, "lm-scores")
    for wave in range(waves):
        texts = cut.where(F.col("wave") == wave).drop("wave")
        rows = model.grams.withColumn("block", F.lit(None).cast("long")).unionByName(_asked(texts, model), allowMissingColumns=True)
        answers = rows.groupBy("bucket").applyInArrow(_answered, "block long, keys binary, c binary, mass binary")
        with shuffles_freed(spark):
            texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(walk, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores; learned outside the held-out seventh."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(documents, train(documents, ~held_out(F.col("doc_id"), 7)))
    return out.select("doc_id", held_out(F.col("doc_id"), 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
