"""Byte-level BPE encoding and decoding over overlapping chunks.

A text longer than CHUNK characters is cut into chunks that overlap by OVERLAP.
All chunks are pre-tokenised in parallel. Matches of the pattern depend only on
what follows their start, so from the first boundary that two neighbours share
(and that the left one reached without touching its end) they agree: there the
chunks are stitched. Where an overlap has no such boundary, as in one very long
word, the seam is matched again from the left chunk's last sure boundary. Each
piece between boundaries is encoded by the ranks; decoding joins raw bytes.

Defined results: null and empty texts have no ids; rows are encoded one by one,
so repeated rows give repeated rows; other columns are kept, whatever their names,
but for earlier ones named ids or decoded, which are replaced; an empty table gives
no rows. The chunks of a very long text are pre-tokenised in as many tasks as there
are; its pieces are encoded where they are joined.
"""

from __future__ import annotations

import base64
import functools
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Pool, bounded_batches, column, release, steps, table, tokenizer_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CHUNK, OVERLAP = 16_384, 256
#: A boundary is sure if so many characters of its chunk follow.
LOOK = 4
CACHE = 200_000
#: Rows of one step of decoding.
ROWS = 500


@functools.cache
def _pattern(pattern: str | None = None):
    import regex

    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return regex.compile(pattern)


def boundaries(text: str, pattern=None) -> np.ndarray:
    """Where matches of the pattern end; it matches every character."""
    n = np.fromiter(map(len, (pattern or _pattern()).findall(text)), np.int64)
    return np.cumsum(n)


def stitch(chunks: list[tuple[int, int, np.ndarray]], text: str, pattern=None) -> np.ndarray:
    """The boundaries of the whole text. chunks: start, end and boundaries (from the text's start) of each, in order."""
    start, end, out = chunks[0]
    done = [out]
    for start, next_end, right in chunks[1:]:
        left = done[-1]
        # near a cut the pattern may lack what it looks for next (a contraction, more white space)
        sure = left[left <= end - LOOK] if end < len(text) else left
        both = np.intersect1d(sure, right, assume_unique=True)
        if len(both):
            p = both[0]
            done[-1] = left[left <= p]
            done.append(right[right > p])
        else:  # no common boundary: match on from the last sure one
            p = int(sure[-1]) if len(sure) else (int(done[-2][-1]) if len(done) > 1 and len(done[-2]) else 0)
            done[-1] = sure
            done.append(p + boundaries(text[p:next_end], pattern))
        end = next_end
    return np.concatenate(done)


def split(n: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of each chunk of a text of n characters."""
    return [(i, min(n, i + chunk + overlap)) for i in range(0, max(n, 1), chunk)]


class Codec:
    """Encodes pieces by the ranks of a vocabulary, each distinct piece once; decodes ids to bytes."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = _pattern()
        self.encoding = tiktoken.Encoding("ranks", pat_str=self.pattern.pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.known = Pool()
        tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, i in self.ranks.items():
            tokens[i] = token
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces in a row, and how many each has."""
        if len(self.known.place) > CACHE:
            self.known = Pool()
        new = list(set(pieces).difference(self.known.place))
        if new:
            # a piece is one match of the pattern, so it is encoded on its own
            ids = [self.encoding.encode_ordinary(p) for p in new]
            self.known.add(new, np.fromiter(itertools.chain.from_iterable(ids), np.int32), np.array(list(map(len, ids)), np.int64))
        return self.known.take(self.known.numbers(pieces))

    def encode(self, texts: list[str], ends: list[np.ndarray] | None = None) -> pa.ListArray:
        """Ids of each text; ends: the boundaries of its pieces, where they are known."""
        cut: list[str] = []
        count = [0]
        for k, text in enumerate(texts):
            if ends is None:
                cut += self.pattern.findall(text)
            else:
                at = [0, *ends[k].tolist()]
                cut += [text[a:b] for a, b in zip(at, at[1:], strict=False)]
            count.append(len(cut))
        ids, n = self.pieces(cut)
        offsets = np.concatenate([[0], np.cumsum(n)])[count]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))

    def decode(self, ids: np.ndarray) -> bytes:
        out = []
        for first in range(0, len(ids), 100_000):
            some = ids[first : first + 100_000]
            n = self.size[some]
            out.append(self.bytes[np.repeat(self.begin[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes())
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec in each Python worker."""
    return Codec(path)


_DECODED = T.StructField("decoded", T.BinaryType())


def _added(df: DataFrame) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])


def encode(documents: DataFrame, vocabulary: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False) -> DataFrame:
    """All columns of documents, with ids. Texts of one chunk are encoded where they lie; the chunks of longer ones are dealt out.

    decoded: with `decoded` too, the bytes of the ids, by the worker that encodes: two steps of Python in a row have a worker each.
    """
    bounded_batches(documents.sparkSession)
    path = tokenizer_path(VOCABULARY, vocabulary)
    kept = documents.drop("ids", "decoded") if decoded else documents.drop("ids")
    names = kept.columns
    last = functools.partial(_decoded, path=path) if decoded else iter
    schema = _added(kept).add(_DECODED) if decoded else _added(kept)
    short = kept.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk)

    def whole(batches):
        c = codec(path)
        for b in steps(batches):
            ids = c.encode(pc.fill_null(column(b, "text"), "").to_pylist())
            yield pa.RecordBatch.from_arrays([*(column(b, n) for n in names), ids], [*names, "ids"])

    # rows of long texts are told apart by a number, as ids may repeat; the first chunk carries the row
    long = kept.where(F.length("text") > chunk)
    row_type = T.StructType(kept.schema.fields)
    numbered = long.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.monotonically_increasing_id().alias("at"))

    def cut(batches):
        for b in batches:
            for k in range(b.num_rows):
                row, at = column(b, "row").slice(k, 1), column(b, "at")[k].as_py()
                text = row.field(names.index("text"))[0].as_py()
                spans = split(len(text), chunk, overlap)
                rows = pa.concat_arrays([row, pa.nulls(len(spans) - 1, row.type)])
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(spans), pa.int64()), pa.array(range(len(spans)), pa.int32()), rows, pa.array([text[x:y] for x, y in spans], pa.string())], ["at", "i", "row", "part"])

    def cut_up(batches):
        for b in batches:
            ends = [boundaries(t).astype(np.int32).tobytes() for t in column(b, "part").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, "at"), column(b, "i"), column(b, "row"), pa.array(ends, pa.binary())], ["at", "i", "row", "ends"])

    at_i_row = [T.StructField("at", T.LongType()), T.StructField("i", T.IntegerType()), T.StructField("row", row_type)]
    parts = numbered.mapInArrow(cut, T.StructType([*at_i_row, T.StructField("part", T.StringType())])).repartition("at", "i")
    gathered = parts.mapInArrow(cut_up, T.StructType([*at_i_row, T.StructField("ends", T.BinaryType())])).groupBy("at").agg(F.first("row", ignorenulls=True).alias("row"), F.sort_array(F.collect_list(F.struct("i", "ends"))).alias("chunks"))

    def join(batches):
        c = codec(path)
        for b in batches:
            for k in range(b.num_rows):
                row = column(b, "row").slice(k, 1)
                text = row.field(names.index("text"))[0].as_py()
                found = []
                for x in column(b, "chunks")[k].as_py():
                    start = x["i"] * chunk
                    found.append((start, min(len(text), start + chunk + overlap), start + np.frombuffer(x["ends"], np.int32).astype(np.int64)))
                ids = c.encode([text], [stitch(found, text)])
                yield pa.RecordBatch.from_arrays([*(row.field(i) for i in range(len(names))), ids], [*names, "ids"])

    return short.mapInArrow(lambda batches: last(whole(batches)), schema).unionByName(gathered.select("row", "chunks").mapInArrow(lambda batches: last(join(batches)), schema))


def _decoded(batches, path: str):
    """The batches with the bytes of their ids."""
    c = codec(path)
    for every in batches:
        for first in range(0, every.num_rows, ROWS):
            b = every.slice(first, ROWS)
            ids = column(b, "ids")
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.decode(flat[i:j]) for i, j in zip(at, at[1:], strict=False)], pa.binary())], [*b.schema.names, "decoded"])
    release()


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """All columns of encoded, with `decoded`: the bytes of its ids."""
    bounded_batches(encoded.sparkSession)
    path = tokenizer_path(VOCABULARY, vocabulary)
    kept = encoded.drop("decoded")
    return kept.mapInArrow(functools.partial(_decoded, path=path), T.StructType([*kept.schema.fields, _DECODED]))


def digests(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """All columns of documents with ids, n_tokens, ids_sha256 and decoded_sha256, of the bytes decoded from the ids."""
    ids = F.col("ids")
    added = ("n_tokens", "ids_sha256", "decoded_sha256")
    out = encode(documents.drop(*added), vocabulary, decoded=True)
    names = [*(c for c in documents.columns if c not in ("ids", *added)), "ids"]
    return out.select(*(F.col(f"`{c}`") for c in names), F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to."""
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "ids")
