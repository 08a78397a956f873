"""Token ids in binary shards, compressed by Re-Pair grammars.

Documents are dealt by ranges of doc_id, sorted, encoded with the tokenizers
library and cut into shards of about SHARD ids. In each shard pairs of
neighbouring ids are replaced by nonterminals, the frequent ones first, until no
pair occurs LEAST times; pairs never reach
across documents, so a document (or a part of one) is decoded by itself: walk its
symbols with their expansion lengths, expand what is needed.

File format: Parquet rows of one shard each, so that any Spark store can hold it:

    part, shard   place in the order of documents
    first         ids before the shard, in its part
    doc_ids       int64, little-endian; a bitmap of nulls is in doc_nulls
    starts        uint32: first symbol of each document, and the number of all
    tokens        uint32: ids of each document
    base, n_rules size of the vocabulary, and number of rules: rule r is symbol base + r
    rules         pairs of symbols, packed
    lengths       ids that each rule expands to, packed
    symbols       the compressed documents, packed

Packed numbers take as many bits each, the highest first, as the largest needs: symbols those of base + n_rules - 1,
lengths `length_bits`. So a pair that is met twice pays for its rule.

Defined results: null texts are empty; each document ends with id 0; documents
are ordered by doc_id, nulls first, then by a hash of the text, so repeated ids
keep all rows; a text of any length is one document, which makes a shard of its own
size if it is longer than SHARD ids; an empty table gives no shards and no rows;
other columns are not looked at.
"""

from __future__ import annotations

import functools
import itertools
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Pool, bounded_batches, column, partitions, shared_path, steps, table, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
SHARD = 1_000_000
END = 0
#: Pairs are replaced until none occurs LEAST times; the first round makes about RULES_A_ROUND rules, each later one up to twice as many.
RULES_A_ROUND, LEAST = 16_000, 2
#: Bytes of text that are encoded at a time.
STEP = 8_000_000
#: Pieces that the library is given in a row: in longer texts each of them takes more time.
RUN = 256
#: Strings that an encoder knows, parts and pieces together, before it forgets all but those of its last step.
CACHE = 1_600_000
SCHEMA = "part int, shard int, first long, doc_ids binary, doc_nulls binary, base int, n_rules int, length_bits int, starts binary, tokens binary, rules binary, lengths binary, symbols binary"


class Encoder:
    """Ids of texts by the tokenizers library, which sees each distinct piece once.

    Spaces begin pieces of the pre-tokenizer, so a text is cut at its spaces, each distinct part is cut
    into pieces by the pre-tokenizer's pattern, and each distinct piece is encoded. A text in which white
    space comes before a space, or one of the vocabulary's added tokens stands, is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # texts that hold an added token are for the library alone
        added = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.hard = "|".join([r"[\s\pZ\x{85}\x0b\x1c-\x1f] ", *added])
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        vocabulary = self.tok.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        # the byte-level alphabet writes each byte as one character
        self.bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self._forget()

    def _forget(self) -> None:
        """Parts and pieces stand in one pool, since most parts are one piece; the empty head of a text that begins with a space has no ids."""
        self.known = Pool()
        self.known.add([""], np.empty(0, np.int32), np.zeros(1, np.int64))

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for i in range(0, len(texts), 1024):
            lists = [e.ids for e in self.tok.encode_batch_fast(texts[i : i + 1024], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids.append(np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn_pieces(self, pieces: list[str]) -> None:
        # pieces that begin with a space, and words with a line's end after each, are encoded many in a row
        spaced, words, single = [], [], []
        for p in pieces:
            (spaced if p[0] == " " and not p.isspace() else words if p.isalpha() else single).append(p)
        ids, sizes = zip(self._row(spaced), self._row(words, "\n"), self._whole(single), strict=True)
        self.known.add(spaced + words + single, np.concatenate(ids), np.concatenate(sizes))

    def _row(self, pieces: list[str], end: str = "") -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, of which the library gets RUN in a row with an end after each (a byte, or none), told apart by the bytes of their ids."""
        ids, _ = self._whole([end.join([*pieces[first : first + RUN], ""]) for first in range(0, len(pieces), RUN)])
        size = pc.binary_length(pa.array(pieces, pa.string())).to_numpy().astype(np.int64) + len(end)
        ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(size), "left") + 1
        return (np.delete(ids, ends - 1) if end else ids), np.diff(ends, prepend=0) - len(end)

    def _learn(self, parts: list[str]) -> np.ndarray:
        """Numbers of distinct parts that aren't known yet."""
        odd, begun, rest = [], [], []
        for i, p in enumerate(parts):
            (odd if p[-1].isspace() else begun if p[0] == " " else rest).append(i)
        number = np.empty(len(parts), np.int64)
        some = [parts[i] for i in odd]
        number[odd] = self.known.add(some, *self._whole(some))
        some = [parts[i] for i in begun]
        number[begun] = self._learn_run(some, self.pattern.findall("".join(some)))
        some = [parts[i] for i in rest]
        number[rest] = self._learn_run(some, [x for p in some for x in self.pattern.findall(p)])
        return number

    def _learn_run(self, parts: list[str], pieces: list[str]) -> np.ndarray:
        if not parts:
            return np.empty(0, np.int64)
        number = self._numbers(pieces, self._learn_pieces)
        length = lambda strings: np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))
        last = np.searchsorted(length(pieces), length(parts), "left")
        out, many = number[last], np.diff(last, prepend=-1) > 1
        if many.any():  # the others are their only piece
            ids, n = self.known.take(number[np.repeat(many, np.diff(last, prepend=-1))])
            ends = np.cumsum(np.diff(last, prepend=-1)[many]) - 1
            out[many] = self.known.add([parts[i] for i in np.flatnonzero(many).tolist()], ids, np.diff(np.cumsum(n)[ends], prepend=0))
        return out

    def _numbers(self, strings: list[str], learn) -> np.ndarray:
        """Numbers of strings, of which `learn` is given those that aren't known yet, each once."""

        def once(new: list[str]) -> np.ndarray:
            learn(list(dict.fromkeys(new)))
            return self.known.numbers(new)

        return self.known.learnt(strings, once)

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        n = pc.binary_length(texts).to_numpy()
        hard = pc.match_substring_regex(texts, self.hard).to_numpy(zero_copy_only=False)
        if hard.any():
            ids, size = self._whole(texts.filter(pa.array(hard)).to_pylist())
            for i, x in zip(np.flatnonzero(hard), np.split(ids, np.cumsum(size)[:-1]), strict=True):
                out[i] = x
        easy = np.flatnonzero(~hard & (n > 0))
        for i in np.flatnonzero(n == 0):
            out[i] = np.empty(0, np.int32)
        if not len(easy):
            return out
        lists = pc.split_pattern(texts.take(pa.array(easy)), " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # what stands before the first space of a text has none of its own
        heads = [words[c] for c in codes[starts[:-1]].tolist()]
        parts = [" " + w for w in words]
        distinct = self.known.learnt(parts, self._learn)
        begin, size = (x[codes] for x in self.known.runs(distinct))
        begin[starts[:-1]], size[starts[:-1]] = self.known.runs(self._numbers(heads, self._learn))
        ids = self.known.ids(begin, size)
        if len(self.known.place) > CACHE:  # the parts of this step stay
            learnt = self.known.take(distinct)
            self._forget()
            self.known.add(parts, *learnt)
        total = np.concatenate([[0], np.cumsum(size)])[starts]
        for k, i in enumerate(easy):
            out[i] = ids[total[k] : total[k + 1]]
        return out


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _sorted_pairs(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of symbols of so many bits (a << bits | b) in ascending order, and the place of each.

    Where both symbols and the place fit into one number, these are sorted, which takes a fraction of an argsort.
    """
    key, place = a.astype(np.int64), width(len(a))
    key <<= bits
    key |= b
    if 2 * bits + place > 63:
        sort = np.argsort(key, kind="stable")
        return key[sort], sort
    key <<= place
    key |= np.arange(len(a))
    key.sort()
    sort = key & ((1 << place) - 1)
    key >>= place
    return key, sort


def _first_by_rank(order: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Which places are taken: of those that overlap (each with the next, where `joined`) the first by rank, and their neighbours are lost."""
    lost = np.int32(2**31 - 1)
    left, right = np.concatenate([[False], joined]), np.concatenate([joined, [False]])
    order = np.concatenate([[lost], order, [lost]]).astype(np.int32)
    # all places at once, then those that are open still
    mine = order[1:-1]
    taken = ((mine < order[:-2]) | ~left) & ((mine < order[2:]) | ~right)
    gone = taken.copy()
    gone[1:] |= taken[:-1] & joined
    gone[:-1] |= taken[1:] & joined
    mine[gone] = lost
    open_ = np.flatnonzero(~gone)
    while len(open_):
        mine = order[open_ + 1]
        win = open_[((mine < order[open_]) | ~left[open_]) & ((mine < order[open_ + 2]) | ~right[open_])]
        taken[win] = True
        order[win + 1] = lost
        order[win[left[win]]] = lost
        order[win[right[win]] + 2] = lost
        open_ = open_[order[open_ + 1] < lost]
    return taken


def compress(ids: np.ndarray, starts: np.ndarray, base: int, rounds: int | None = None, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair in rounds: symbols (rules from `base` on), starts of the documents in them, rules (pairs) and expansion lengths.

    Rounds (of any number, unless `rounds` is given) go on until no pair occurs `least` times. A round replaces
    the most frequent pairs, more of them each time; where occurrences overlap, that of the more frequent pair is
    replaced, and in a run of one symbol every other pair from the left. Only places whose pair may still be
    replaced are looked at: an old pair's count never grows, so one below `least` is left for good, and new
    pairs begin at or before a replaced one.
    """
    seq = ids.astype(np.int32)
    begins = np.zeros(len(ids) + 1, bool)  # and one more, behind the last
    begins[starts] = True
    begins[-1] = True
    active = np.flatnonzero(~begins[1:])
    rules, lengths = np.empty((0, 2), np.int64), np.empty(0, np.int64)
    most, turn = RULES_A_ROUND, 0
    while len(active) and (rounds is None or turn < rounds):
        turn += 1
        a, b = seq[active], seq[1:][active]
        odd = np.zeros(len(active), bool)
        runs = np.flatnonzero(a == b)
        if len(runs):  # every second place of a run
            new = np.concatenate([[True], (np.diff(runs) > 1) | (np.diff(active[runs]) > 1)])
            place = np.arange(len(runs))
            odd[runs] = (place - np.maximum.accumulate(np.where(new, place, 0))) % 2 == 1
        bits = width(base + len(rules))
        key, sort = _sorted_pairs(a, b, bits)
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        met = np.diff(begin, append=len(key))
        count = met - np.bincount(np.searchsorted(begin, np.flatnonzero(odd[sort]), "right") - 1, minlength=len(begin)) if odd.any() else met
        # pairs that may still be replaced, and those that are now
        live = np.flatnonzero(count >= least)
        if not len(live):
            break
        bar = max(least, int(np.partition(count[live], -most)[-most])) if len(live) > most else least
        most *= 2
        look = np.zeros(len(seq), bool)
        still = np.empty(len(active), bool)
        still[sort] = np.repeat(count >= least, met)
        look[active] = still
        often = np.flatnonzero(count >= bar)
        pairs = key[begin[often]]
        place = sort[np.repeat(count >= bar, met)]
        place <<= 32
        place |= np.repeat(np.arange(len(pairs)), met[often])
        place.sort()
        pair = place & 0xFFFFFFFF
        place >>= 32
        if len(runs):
            use = ~odd[place]
            place, pair = place[use], pair[use]
        at = active[place]
        # pairs of one symbol before the others, then by their counts
        of_two = (pairs >> bits) != (pairs & ((1 << bits) - 1))
        rank = np.empty(len(pairs), np.int32)
        rank[np.lexsort((-count[often], of_two))] = np.arange(len(pairs), dtype=np.int32)
        taken = _first_by_rank(rank[pair], np.diff(at) == 1)
        at, pair = at[taken], pair[taken]
        used = np.bincount(pair, minlength=len(pairs)) >= least
        chosen = np.flatnonzero(used)
        if len(chosen) < len(pairs):
            mine = used[pair]
            at, pair = at[mine], pair[mine]
        number = np.zeros(len(pairs), np.int32)
        number[chosen] = np.arange(base + len(rules), base + len(rules) + len(chosen))
        both = np.stack([pairs[chosen] >> bits, pairs[chosen] & ((1 << bits) - 1)], 1)
        size = np.where(both < base, 1, lengths[np.maximum(both - base, 0)] if len(lengths) else 1)
        seq[at] = number[pair]
        rules, lengths = np.concatenate([rules, both]), np.concatenate([lengths, size.sum(1)])
        look[at] = True
        # before the first symbol of a document ends another one
        inner = at[~begins[at]]
        gone = at + 1  # never the first symbol of a document
        alive = np.ones(len(seq) + 1, bool)
        alive[gone] = False
        inner -= 1
        inner -= ~alive[inner]  # where the one before is itself the second of a pair
        look[inner] = True
        look &= alive[:-1]
        seq, begins, look = seq[alive[:-1]], begins[alive], look[alive[:-1]]
        active = np.flatnonzero(look & ~begins[1:])
    return seq, np.flatnonzero(begins), rules, lengths


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids of symbols: rules are opened once, each into the run of its ids, and the runs are joined."""
    if not len(rules):
        return symbols.astype(np.int64)
    size = np.ones(base + len(rules), np.int64)
    begin = np.concatenate([np.arange(base), np.zeros(len(rules), np.int64)])
    flat, done, high = np.arange(base, dtype=np.int32), 0, rules.max(1)

    def opened(now: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = np.repeat(begin[now] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return flat[at]

    while done < len(rules):  # rules whose halves are known, a run of them at a time
        ready = np.flatnonzero(high[done:] >= base + done)
        last = done + (int(ready[0]) if len(ready) else len(rules) - done)
        now = rules[done:last].ravel()
        n = size[now]
        both = n[::2] + n[1::2]
        size[base + done : base + last] = both
        begin[base + done : base + last] = len(flat) + np.cumsum(both) - both
        flat = np.concatenate([flat, opened(now, n)])
        done = last
    return opened(symbols, size[symbols])


def decode_range(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int, first: int, last: int) -> np.ndarray:
    """Ids first..last of a document, opening only the symbols that hold them."""
    size = np.where(symbols < base, 1, lengths[np.maximum(symbols.astype(np.int64) - base, 0)] if len(lengths) else 1)
    ends = np.cumsum(size)
    a, b = np.searchsorted(ends, first, "right"), np.searchsorted(ends, last, "left")
    before = int(ends[a - 1]) if a else 0
    return expand(symbols[a : b + 1], rules, base)[first - before : last - before]


def _pack(x: np.ndarray) -> bytes:
    return x.astype("<u4").tobytes()


def width(largest: int) -> int:
    """Bits of a packed number."""
    return max(1, int(largest).bit_length())


def pack_bits(x: np.ndarray, bits: int) -> bytes:
    """Numbers of so many bits one after the other, the highest bit first."""
    each = np.unpackbits(np.ascontiguousarray(x.ravel().astype(">u4")).view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(each[:, 32 - bits :]).tobytes()


def unpack_bits(raw: bytes, bits: int, n: int) -> np.ndarray:
    each = np.zeros((n, 32), np.uint8)
    each[:, 32 - bits :] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits).reshape(n, bits)
    return np.packbits(each, axis=1).view(">u4").ravel().astype(np.int64)


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (pairs) and expansion lengths of a shard's row."""
    bits, n = width(row["base"] + row["n_rules"] - 1), row["n_rules"]
    symbols = unpack_bits(row["symbols"], bits, int(np.frombuffer(row["starts"], "<u4")[-1]))
    return symbols, unpack_bits(row["rules"], bits, 2 * n).reshape(-1, 2), unpack_bits(row["lengths"], row["length_bits"], n)


def write(documents: DataFrame, path: str, vocabulary: str | None = None, shard: int = SHARD) -> None:
    """Write the ids of all texts to `path`, in order of doc_id."""
    spark = documents.sparkSession
    bounded_batches(spark)
    file = tokenizer_path(VOCABULARY, vocabulary)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # the hash deals out the rows of one id, should there be many
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(max(partitions(spark), 1), *order).sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id())

    def run(batches):
        enc = encoder(file)
        first, number, part = 0, 0, None
        docs: list = []
        held: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal first, number, docs, held, size
            n = np.array([len(x) for x in held], np.int64)
            ids = np.concatenate(held)
            symbols, starts, rules, lengths = compress(ids, np.cumsum(n) - n, enc.size)
            bits, length_bits = width(enc.size + len(rules) - 1), width(lengths.max(initial=0))
            key = pa.array(docs, pa.int64())
            values = [part, number, first, pc.fill_null(key, 0).to_numpy().astype("<i8").tobytes(), np.packbits(key.is_null().to_numpy(zero_copy_only=False)).tobytes(), enc.size, len(rules), length_bits, _pack(starts), _pack(n), pack_bits(rules, bits), pack_bits(lengths, length_bits), pack_bits(symbols, bits)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 2, *[pa.int32()] * 3, *[pa.binary()] * 5]
            first, number, docs, held, size = first + len(ids), number + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

        end = np.array([END], np.int32)
        for b in batches:
            for piece in steps([b], most=STEP):
                part = column(piece, "part")[0].as_py()
                for doc, ids in zip(column(piece, "doc_id").to_pylist(), enc.batch(column(piece, "text")), strict=True):
                    docs.append(doc)
                    held.append(np.concatenate([ids, end]))
                    size += len(held[-1])
                    if size >= shard:
                        yield flush()
        if docs:
            yield flush()

    ordered.mapInArrow(run, SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files."""
    import zlib

    files = spark.read.parquet(path)
    # one number for each part (a partition of the writer), however many documents there are
    totals = files.select("part", "first", F.expr("length(tokens) div 4").alias("docs"), "tokens").mapInArrow(_sizes, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    before, offset = 0, {}
    for r in totals:
        offset[r["part"]] = before
        before += r["n"]

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                tokens = np.frombuffer(row["tokens"], "<u4").astype(np.int64)
                symbols, rules, _ = unpacked(row)
                ids = memoryview(expand(symbols, rules, row["base"]).astype("<u4")).cast("B")
                ends = np.cumsum(tokens)
                crc = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), tokens.tolist(), strict=True)]
                nulls = np.unpackbits(np.frombuffer(row["doc_nulls"], np.uint8))[: len(tokens)].astype(bool)
                doc = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=nulls)
                yield pa.RecordBatch.from_arrays([doc, pa.array(offset[row["part"]] + row["first"] + ends - tokens), pa.array(tokens), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _sizes(batches):
    for b in batches:
        n = [int(np.frombuffer(x, "<u4").sum(dtype=np.int64)) for x in column(b, "tokens").to_pylist()]
        yield pa.RecordBatch.from_arrays([column(b, "part"), pa.array(n, pa.int64())], ["part", "n"])


def describe(spark: SparkSession, path: str) -> pd.DataFrame:
    """Bytes of the files' columns, and of the same ids as numbers of 16 bits (32 where the vocabulary needs it)."""
    files = spark.read.parquet(path)
    size = [F.sum(F.length(c)).alias(c) for c in ("rules", "lengths", "symbols", "starts", "tokens")]
    out = files.agg(F.count("*").alias("shards"), F.max("base").alias("base"), *size).toPandas()
    ids = files.select("part", "tokens").mapInArrow(_sizes, "part int, n long").agg(F.sum("n")).first()[0] or 0
    return out.assign(raw=ids * np.where(out.base <= 65_536, 2, 4))


def document(row: dict, at: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids first..last of the at-th document of a shard's row, opening only the symbols that hold them."""
    starts = np.frombuffer(row["starts"], "<u4").astype(np.int64)
    n = int(np.frombuffer(row["tokens"], "<u4")[at])
    symbols, rules, lengths = unpacked(row)
    return decode_range(symbols[starts[at] : starts[at + 1]], rules, lengths, row["base"], first, n if last is None else last)


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, ids and checksum, read back from the files that hold them."""
    path = shared_path(spark, "token-shards")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path)
