"""Media files and chunks in, deduplicated by content; packets by id; exports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import join_counted
from ..schemas import TABLES, conform

CHUNK = 131_072
#: File name extensions by kind, and the extension of files that have none.
KINDS = {"video": ("mp4", "mkv", "mov", "avi", "webm", "mpg", "mpeg", "m4v"), "audio": ("mp3", "wav", "flac", "ogg", "m4a", "aac"), "image": ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff")}
DEFAULT_EXTENSION = {"video": "mp4", "audio": "mp3", "other": "msg"}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def with_media_kind(df: DataFrame, name: str = "filename", kind_of_bare: str = "video") -> DataFrame:
    """kind and ext from the file name; a name without extension is of kind_of_bare with its default extension."""
    ext = extension(F.col(name))
    kind = None
    for k, exts in KINDS.items():
        kind = F.when(ext.isin(*exts), k) if kind is None else kind.when(ext.isin(*exts), k)
    bare = ext == ""
    return df.withColumns({"kind": F.when(bare, kind_of_bare).otherwise(kind.otherwise("other")), "ext": F.when(bare, DEFAULT_EXTENSION.get(kind_of_bare, "msg")).otherwise(ext)})


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """(filename, ext, kind, content, sha1) of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    return with_sha1(with_media_kind(named), "content")


def dump_chunks(df: DataFrame, id: str = "id", data: str = "data", size: int = CHUNK) -> DataFrame:
    """(id, seq, data): pieces of `size`, the last one shorter; empty values have none."""
    n = F.length(data)
    at = df.where(n > 0).select(id, data, F.explode(F.sequence(F.lit(0), F.expr(f"(length({data}) - 1) div {size}").cast("int"))).alias("seq"))
    return at.select(id, "seq", F.substring(F.col(data), F.col("seq") * size + 1, F.lit(size)).alias("data"))


def reassemble(chunks: DataFrame, id: str | list[str] = "id", seq: str = "seq", data: str = "data") -> DataFrame:
    """(id, data): each value's chunks joined in order of seq; id may be several columns (a stream of many values)."""
    keys = [id] if isinstance(id, str) else list(id)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(data).alias("d"))))
    parts = F.transform(ordered, lambda x: x["d"])
    text = dict(chunks.dtypes)[data] == "string"
    whole = F.array_join(parts, "") if text else F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b))
    return chunks.groupBy(*keys).agg(whole.alias(data))


def with_sha1(df: DataFrame, data: str = "content") -> DataFrame:
    return df.withColumn("sha1", F.sha1(F.col(data).cast("binary")))


def map_contents(new: DataFrame, existing: DataFrame, id: str = "media_id", seq: str = "ingest_seq") -> DataFrame:
    """New rows with canonical_id, and _new where their content isn't stored.

    The canonical id of a hash is the stored one, else the first by seq (then id). An
    aggregate gives one row for each hash, so a hash that a third of the rows share is summed before it is shuffled,
    and joined by broadcast. Rows without a hash are each their own.
    """
    stored = existing.where("sha1 is not null").groupBy("sha1").agg(F.min(id).alias("_stored"))
    first = new.groupBy("sha1").agg(F.min(F.struct(F.col(seq), F.col(id))).alias("_f"), F.count("*").alias("n")).select("sha1", F.col(f"_f.{id}").alias("_first"), "n")
    canon = first.where("sha1 is not null").join(stored, "sha1", "left").select("sha1", F.coalesce("_stored", "_first").alias("canonical_id"), F.col("_stored").isNull().alias("_new"), "n")
    alone = new.where("sha1 is null").withColumns({"canonical_id": F.col(id), "_new": F.lit(True)})
    return join_counted(new.where("sha1 is not null"), canon, ["sha1"], new.count()).drop("n").unionByName(alone)


def kept_and_mapped(found: DataFrame, id: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of map_contents' rows those that are kept, and all as (new_id, canonical_id)."""
    kept = found.where((F.col(id) == F.col("canonical_id")) & F.coalesce("_new", F.lit(True))).select(*columns)
    return kept, found.select(F.col(id).alias("new_id"), "canonical_id")


def dedup_ingest(new: DataFrame, existing: DataFrame, id: str = "media_id", seq: str = "ingest_seq") -> tuple[DataFrame, DataFrame]:
    """(kept, mapping): new rows whose sha1 is neither stored nor earlier in the batch; and new id -> canonical id (see map_contents)."""
    return kept_and_mapped(map_contents(new, existing, id, seq), id, new.columns)


def insert_if_absent(new: DataFrame, existing: DataFrame, on_conflict: str = "keep", id: str = "id") -> tuple[DataFrame, DataFrame]:
    """(table, conflicts): existing rows and the new ones of other ids; conflicts are the new rows that did not get in.

    Of new rows with one id one gets in, the first by a hash of its columns; rows of a null id all do.
    "reject" raises no error here: the caller gets the conflicts and decides; with "keep" they are stored already.
    """
    if on_conflict not in ("keep", "reject"):
        raise ValueError("on_conflict is keep or reject")
    absent = new.join(existing.select(id), id, "left_anti").select(*new.columns)
    row = F.struct(*(F.col(f"`{c}`") for c in new.columns))
    first = absent.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("_id")).agg(F.min_by(row, F.xxhash64(row)).alias("_row")).select("_row.*")
    fresh = first.unionByName(absent.where(F.col(id).isNull()))
    conflicts = new.join(existing.select(id), id, "left_semi").select(*new.columns).unionByName(absent.exceptAll(fresh))
    return existing.unionByName(fresh), conflicts


def delete(df: DataFrame, ids: DataFrame | Iterable, id: str = "id") -> DataFrame:
    """Rows of other ids; ids that aren't there don't matter. delete_packets does so in a stored table."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(id).distinct(), id, "left_anti").select(*df.columns)
    return df.where(~F.coalesce(F.col(id).isin(list(ids)), F.lit(False)))


def exists(df: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """(id, found) for each asked id."""
    have = df.select(id).distinct().withColumn("_f", F.lit(True))
    return ids.select(id).join(have, id, "left").select(id, F.coalesce("_f", F.lit(False)).alias("found"))


def sharded(df: DataFrame, id: str = "id") -> DataFrame:
    """Two levels of directories from the id's first four characters: shard1, shard2."""
    return df.withColumns({"shard1": F.substring(F.col(id).cast("string"), 1, 2), "shard2": F.substring(F.col(id).cast("string"), 3, 2)})


def write_packets(df: DataFrame, path: str, id: str = "id", mode: str = "append") -> None:
    """Packets in folders by type and shard, a file each unless it is crowded."""
    sharded(df, id).hint("rebalance", "type", "shard1", "shard2").write.mode(mode).partitionBy("type", "shard1", "shard2").parquet(path)


#: The row that stands in a shard whose packets were all deleted.
_EMPTIED = "id IS NULL AND shard1 IS NOT NULL"


def _packets(spark: SparkSession, path: str) -> DataFrame:
    """The stored packets; shards stay texts, also where all of them look like numbers."""
    known = spark.read.parquet(path).schema
    fields = [T.StructField(f.name, T.StringType()) if f.name in ("type", "shard1", "shard2") else f for f in known.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def load_packets(spark: SparkSession, path: str, kind: str, ids: Iterable[str] | None = None) -> DataFrame:
    """Packets of one type, and of some ids if given: partitions of other types and shards aren't read."""
    if kind not in TABLES:
        raise ValueError(f"unknown packet type {kind!r}")
    out = _packets(spark, path).where(F.col("type") == kind).where(f"NOT ({_EMPTIED})")
    if ids is not None:
        ids = list(ids)
        out = out.where(F.col("shard1").isin([i[:2] for i in ids]) & F.col("shard2").isin([i[2:4] for i in ids]) & F.col("id").isin(ids))
    return out.drop("shard1", "shard2")


def delete_packets(spark: SparkSession, path: str, ids: DataFrame, id: str = "id") -> None:
    """Remove the packets of these ids, of whatever type, from a table of write_packets.

    Ids tell their shards, so only these are read, and of them those that lose a packet are written again. New files
    replace a partition's old ones when the whole job is through (dynamic overwrite): a task or a job that fails
    leaves the table as it was, and a delete can be run again. A shard that loses all its packets keeps one row
    without an id, which loads leave out. Ids that aren't there don't matter.
    """
    places = ["type", "shard1", "shard2"]
    gone = sharded(ids.select(F.col(id).cast("string").alias("id")).where("id is not null").distinct())
    # a row for each folder of a shard at most, as the table's own list of files has
    near = _packets(spark, path).join(F.broadcast(gone.select("shard1", "shard2").distinct()), ["shard1", "shard2"], "left_semi")
    lost = near.join(gone.select("id"), "id", "left_semi").select(*places).distinct()
    rest = near.join(lost, places, "left_semi").join(gone.select("id"), "id", "left_anti")
    empty = lost.join(rest.select(*places).distinct(), places, "left_anti")
    # one file a folder, but a crowded folder is split
    left = rest.unionByName(empty, allowMissingColumns=True).hint("rebalance", *places)
    left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*places).parquet(path)


def write_table(df: DataFrame, path: str, name: str, mode: str = "overwrite", partition_by: Iterable[str] = ()) -> None:
    conform(df, name).write.mode(mode).partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return conform(spark.read.schema(TABLES[name]).parquet(path), name)


def check_blobs(meta: DataFrame, blobs: DataFrame, id: str = "id") -> None:
    """Raise unless metadata and blobs have the same number of rows."""
    m, b = meta.count(), blobs.count()
    if m != b:
        raise ValueError(f"{m} records but {b} blobs")


def export_json(df: DataFrame, by: Iterable[str], order: str, name: str = "data") -> DataFrame:
    """(by, json): one object for each packet, its records nested in order."""
    by = list(by)
    rest = [c for c in df.columns if c not in by]
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*rest).alias("r")))), lambda x: x["r"])
    return df.groupBy(*by).agg(items.alias(name)).select(*by, F.to_json(F.struct(*by, name)).alias("json"))


def extract_all(df: DataFrame, path: str, by: str = "label") -> None:
    """Every child of a list in a directory of its own."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def fill_segments(segments: DataFrame, media: DataFrame) -> DataFrame:
    """A missing start is 0, a missing end the media's duration (media_id, duration)."""
    met = segments.join(media.select("media_id", F.col("duration").alias("_d")), "media_id", "left")
    return met.withColumns({"start_s": F.coalesce("start_s", F.lit(0.0)), "end_s": F.coalesce("end_s", "_d")}).drop("_d")


def canonical_order(df: DataFrame, by: str, order: str) -> DataFrame:
    return df.withColumn("idx", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)
