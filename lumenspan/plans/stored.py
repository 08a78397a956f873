"""Queries that write to the shared folder, stream or delete there, and read back."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import shared_dir
from ..schemas import TABLES
from ..sources import ingest
from ..streaming.ingest import ingest_stream, reassemble_stream
from . import registry
from .registered import _query, _r


def _folder(df: DataFrame, name: str) -> str:
    return f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@_query("ingest_stream", "documents", """
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, sha1(text) AS h FROM documents), c AS (SELECT id, coalesce(first_value(id) OVER (PARTITION BY h ORDER BY doc_id % 3, doc_id), id) AS canonical_id, h FROM d WHERE h IS NOT NULL UNION ALL SELECT id, id, h FROM d WHERE h IS NULL)
SELECT 'mapped' AS part, id, canonical_id FROM c UNION ALL SELECT 'kept', id, id FROM c WHERE id = canonical_id""")
def _(d):
    """Three folders of documents, one a run: each run goes on from the checkpoint of the one before."""
    spark, path = d.sparkSession, _folder(d, "ingest")
    rows = d.select(F.col("doc_id").cast("string").alias("media_id"), F.col("doc_id").alias("ingest_seq"), F.col("text").alias("content"), (F.col("doc_id") % 3).alias("turn"))
    rows.write.partitionBy("turn").parquet(f"{path}/all")
    for turn in range(3):
        spark.read.parquet(f"{path}/all").where(F.col("turn") == turn).drop("turn").write.parquet(f"{path}/in/{turn}")
        stream = spark.readStream.schema("media_id string, ingest_seq long, content string").parquet(f"{path}/in/*")
        ingest_stream(stream, f"{path}/store", f"{path}/map", f"{path}/checkpoint", digits=1).awaitTermination()
    kept = spark.read.parquet(f"{path}/store").select(F.lit("kept").alias("part"), F.col("media_id").alias("id"), F.col("media_id").alias("canonical_id"))
    return spark.read.parquet(f"{path}/map").select(F.lit("mapped").alias("part"), F.col("new_id").alias("id"), "canonical_id").unionByName(kept)


@_query("reassemble_stream", "documents", "SELECT doc_id AS id, text AS data, true AS complete FROM documents WHERE length(text) > 0")
def _(d):
    """Chunks out of order in four folders, two in a run of two batches, the others in one batch of a run after a stop."""
    spark, path, size = d.sparkSession, _folder(d, "reassemble"), 1024
    values = d.select(F.col("doc_id").alias("id"), F.col("text").alias("data"))
    ends = values.select("id", F.expr(f"(length(data) - 1) div {size}").alias("end"))
    chunks = ingest.dump_chunks(values, size=size).join(ends, "id").select("id", "seq", (F.col("seq") == F.col("end")).alias("last"), "data")
    chunks.withColumn("turn", F.pmod(F.xxhash64("id", "seq"), F.lit(4))).write.partitionBy("turn").parquet(f"{path}/all")
    for run in range(2):
        files = 0
        for turn in (2 * run, 2 * run + 1):
            spark.read.parquet(f"{path}/all").where(F.col("turn") == turn).drop("turn").write.parquet(f"{path}/in/{turn}")
            files += len(spark.read.parquet(f"{path}/in/{turn}").inputFiles())
        stream = spark.readStream.schema("id long, seq int, last boolean, data string").option("maxFilesPerTrigger", math.ceil(files / (2 - run))).parquet(f"{path}/in/*")
        reassemble_stream(stream, f"{path}/whole", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/whole").select("id", "data", "complete")


def _packet_id(n):
    """Hexadecimal ids of which four hundred neighbours share a shard."""
    return F.concat(F.lpad(F.hex(F.expr(f"{n} div 400")), 4, "0"), F.md5(F.col(n).cast("string").cast("binary")))


_PACKET_ID = "lpad(printf('%X', CAST({0} // 400 AS BIGINT)), 4, '0') || md5(CAST({0} AS VARCHAR))"


@_query("delete_packets", "documents orders", f"""
WITH p AS (SELECT doc_id, {_PACKET_ID.format("doc_id")} AS id, CASE doc_id % 3 WHEN 0 THEN 'series' WHEN 1 THEN 'shots' ELSE 'boxes' END AS type, lang AS name FROM documents)
SELECT id, type, name FROM p WHERE type <> 'boxes' AND doc_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def _(d, o):
    """Packets of three types are written, those whose number is a finished order's are deleted, and two types are loaded."""
    spark, path = d.sparkSession, _folder(d, "packets")
    kind = F.when(F.col("doc_id") % 3 == 0, "series").when(F.col("doc_id") % 3 == 1, "shots").otherwise("boxes")
    packets = d.select(_packet_id("doc_id").alias("id"), kind.alias("type"), F.col("lang").alias("name"))
    ingest.write_packets(packets, path)
    ingest.delete_packets(spark, path, o.where("o_orderstatus = 'F'").select(_packet_id("o_orderkey").alias("id")))
    loaded = [ingest.load_packets(spark, path, kind) for kind in ("series", "shots")]
    return loaded[0].unionByName(loaded[1]).select("id", "type", "name")


@_query("load_packets", "documents benchmark", f"""
SELECT {_PACKET_ID.format("doc_id")} AS id, lang AS name, source AS ref_id FROM documents WHERE doc_id % 2 = 0 AND doc_id IN (SELECT item_id FROM benchmark)""")
def _(d, asked):
    """Of packets of two types those of one type and of a stated list of ids."""
    path = _folder(d, "packets")
    packets = d.select(_packet_id("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, "media").otherwise("shots").alias("type"), F.col("lang").alias("name"), F.col("source").alias("ref_id"))
    ingest.write_packets(packets, path)
    ids = [r["id"] for r in asked.select(_packet_id("item_id").alias("id")).distinct().collect()]
    return ingest.load_packets(d.sparkSession, path, "media", ids).select("id", "name", "ref_id")


@_query("read_media", "documents", """
SELECT sha1(string_agg(text || chr(10), '' ORDER BY doc_id)) AS sha1, 'txt' AS ext, 'other' AS kind, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL GROUP BY doc_id // 50""")
def _(d):
    """Files of fifty documents each are written as texts and read as media."""
    path = _folder(d, "media")
    rows = d.where("text is not null").select("doc_id", "text", F.expr("doc_id div 50").alias("file"))
    rows.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "text").write.partitionBy("file").text(path)
    return ingest.read_media(d.sparkSession, path).select("sha1", "ext", "kind", F.length("content").cast("long").alias("bytes"))


@_query("typed_tables", "series", """
SELECT CAST(media_id AS VARCHAR) AS media_id, label, label_idx, round(time, 6) AS time, round(y, 6) AS y, 0.2 AS delta_time FROM series""")
def _(s):
    """The typed table of series, written by label and read with its fixed schema."""
    path = _folder(s, "series")
    typed = s.select(F.col("media_id").cast("string").alias("media_id"), F.concat_ws("/", "media_id", "label").alias("series_id"), "label", "label_idx", "time", "y", F.lit(0.2).alias("delta_time"))
    ingest.write_table(typed.withColumn("extra", F.lit(1)), path, "series", partition_by=["label"])
    back = ingest.read_table(s.sparkSession, path, "series")
    assert back.columns == TABLES["series"].names
    return back.select("media_id", "label", "label_idx", *_r("time", "y"), "delta_time")


@_query("optional_inputs", "boxes faces images", """
WITH f AS (SELECT id AS k FROM boxes WHERE h >= 60)
SELECT 'boxes' AS part, id FROM boxes WHERE id IN (SELECT k FROM f) UNION ALL SELECT 'faces', id FROM faces WHERE id IN (SELECT k FROM f)
UNION ALL SELECT 'boxes with images', id FROM boxes WHERE id IN (SELECT k FROM f) UNION ALL SELECT 'images', id FROM images WHERE id * 10 + 1 IN (SELECT k FROM f)""")
def _(b, f, i):
    """The face filter without its optional tables, and with one of them."""
    given = {"boxes": b.withColumn("ref_id", F.col("id")), "faces": f.withColumn("media_id", F.lit(None).cast("string"))}
    alone = registry.run("face_size_filter", given, {"min_face_height": 60})
    more = registry.run("face_size_filter", given | {"images": i.withColumn("ref_id", F.col("id") * 10 + 1)}, {"min_face_height": 60})
    assert set(alone) == {"boxes", "faces"} and set(more) == {"boxes", "faces", "images"}
    part = lambda name, df: df.select(F.lit(name).alias("part"), "id")
    return part("boxes", alone["boxes"]).unionByName(part("faces", alone["faces"])).unionByName(part("boxes with images", more["boxes"])).unionByName(part("images", more["images"]))


@_query("union_inputs", "frames images", """
SELECT 'frames' AS part, CAST(media_id AS VARCHAR) AS media_id, frame_idx AS n FROM frames QUALIFY row_number() OVER (PARTITION BY media_id, ceil(time * 0.00002) ORDER BY time, frame_idx) = 1
UNION ALL SELECT 'images', CAST(media_id AS VARCHAR), CAST(id AS BIGINT) FROM images QUALIFY row_number() OVER (PARTITION BY media_id, ceil(id / 100.0) ORDER BY id) = 1""")
def _(frames_, i):
    """An input that is either frames of a video or a list of images with a place for a time: one table serves both."""
    take = lambda df, fps: registry.run("thumbnail_generator", {"frames": df.withColumns({"w": F.lit(640), "h": F.lit(360)})}, {"fps": fps, "max_dim": 128})["frames"]
    images = i.select("media_id", F.col("id").alias("frame_idx"), F.col("id").cast("double").alias("time"))
    part = lambda name, df: df.where("out_w = 128 and out_h = 72").select(F.lit(name).alias("part"), F.col("media_id").cast("string").alias("media_id"), F.col("frame_idx").cast("long").alias("n"))
    return part("frames", take(frames_, 0.00002)).unionByName(part("images", take(images, 0.01)))
