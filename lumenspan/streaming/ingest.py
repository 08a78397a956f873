"""Streaming ingest: deduplicated media in a store by hash, and chunks put together in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..sources.ingest import kept_and_mapped, map_contents, with_sha1

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dedup_within(stream: DataFrame, time: str, delay: str = "1 hour", data: str = "content") -> DataFrame:
    """Drop contents seen within the watermark; state is bounded by the delay."""
    return with_sha1(stream, data).withWatermark(time, delay).dropDuplicatesWithinWatermark(["sha1"])


def stored_hashes(spark: SparkSession, store: str, prefixes: list[str], id: str = "media_id") -> DataFrame | None:
    """(id, sha1, batch) of the store's buckets of these prefixes; other buckets are neither listed nor read. None: none is there."""
    if not prefixes:
        return None
    try:
        return spark.read.option("basePath", store).parquet(f"{store}/prefix={{{','.join(sorted(prefixes))}}}").select(id, "sha1", "batch")
    except Exception as e:  # the store isn't there before the first batch
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def merge_batch(batch: DataFrame, number: int, store: str, mapping: str, id: str = "media_id", seq: str = "ingest_seq", data: str = "content", digits: int = 2) -> None:
    """Put a batch into the store.

    The store lies in buckets by the first digits of the hash (16 ** digits of them), and in each by batch: a batch
    lists and reads the buckets that it has hashes for, and of those two columns. What is kept and what is mapped come
    from one computed frame. Each batch writes its own folders, so one that is run again replaces them by the same rows.
    """
    new = with_sha1(batch, data).withColumn("prefix", F.substring("sha1", 1, digits)).persist(StorageLevel.DISK_ONLY)
    touched = [r["prefix"] for r in new.where("prefix is not null").select("prefix").distinct().collect()]
    have = stored_hashes(batch.sparkSession, store, touched, id)
    have = new.select(id, "sha1").limit(0) if have is None else have.where(F.col("batch") != number).select(id, "sha1")
    found = map_contents(new, have, id, seq).persist(StorageLevel.DISK_ONLY)
    kept, mapped = kept_and_mapped(found, id, new.columns)
    kept.withColumn("batch", F.lit(number)).hint("rebalance", "prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix", "batch").parquet(store)
    mapped.write.mode("overwrite").parquet(f"{mapping}/batch={number}")
    found.unpersist()
    new.unpersist()


def ingest_stream(stream: DataFrame, store: str, mapping: str, checkpoint: str, id: str = "media_id", seq: str = "ingest_seq", data: str = "content", digits: int = 2, trigger: dict | None = None) -> StreamingQuery:
    """Keep each content once for good: every batch meets the stored hashes, new ids map to stored ones (see merge_batch)."""
    merge = lambda batch, number: merge_batch(batch, number, store, mapping, id, seq, data, digits)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class _Joiner(StatefulProcessor):
    """The chunks of one value: a list of them until all have come, then a mark that it is done.

    State: `parts`, the chunks; `seen`, the places that came, the last place if it is known, and whether the value is
    out. With `patience` (ms) both are forgotten so long after the newest chunk, and a value that is still open then
    goes out as incomplete.
    """

    def __init__(self, chunk: str, text: bool, patience: int | None):
        self.chunk, self.text, self.patience = chunk, text, patience

    def init(self, handle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", f"seq int, data {self.chunk}")
        self.seen = handle.getValueState("seen", "seqs array<int>, last int, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seqs, last, done = self.seen.get() if self.seen.exists() else ([], None, False)
        known, new, newest = set(seqs), [], None
        for frame in rows:
            if self.patience is not None:
                newest = max(x for x in (newest, frame["time"].max()) if x is not None)
            for seq, end, data in zip(frame["seq"].tolist(), frame["last"].tolist(), frame["data"].tolist(), strict=True):
                last = seq if end else last
                if seq not in known and not done:
                    known.add(seq)
                    new.append((seq, data))
        if self.patience is not None:
            due = int(newest.timestamp() * 1000) + self.patience
            old = [t for t in self.handle.listTimers()]
            if not old or due > max(old):
                for t in old:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(due)
        if done:
            return
        if last is not None and len(known) == last + 1:
            every = sorted([*self.parts.get(), *new], key=lambda p: p[0]) if seqs else sorted(new, key=lambda p: p[0])
            self.parts.clear()
            self.seen.update(([], last, True))
            yield self._row(key, ("" if self.text else b"").join(p[1] if self.text else bytes(p[1]) for p in every), True)
        elif new:
            self.parts.appendList(new)
            self.seen.update((sorted(known), last, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = not self.seen.exists() or self.seen.get()[2]
        self.parts.clear()
        self.seen.clear()
        if not done:
            yield self._row(key, None, False)

    def _row(self, key, data, complete: bool) -> pd.DataFrame:
        return pd.DataFrame({"id": [key[0]], "data": pd.Series([data], dtype=object), "complete": [complete]})

    def close(self) -> None:
        pass


def reassemble_stream(chunks: DataFrame, whole: str, checkpoint: str, time: str | None = None, patience: str = "1 hour", trigger: dict | None = None) -> StreamingQuery:
    """(id, data, complete) in `whole`: values whose chunks 0..last have all come; chunks: (id, seq, last BOOLEAN, data).

    Chunks may come in any order, repeatedly, and over many batches and restarts. They wait in the keyed state of their
    id (RocksDB, with the query's checkpoint), so a batch touches the ids it has chunks for and reads no table. With an
    event time column, state is forgotten `patience` after an id's newest chunk: a value that is open then goes out
    without data as incomplete, and chunks of a finished one count as new from there on. Without it a finished id
    leaves a mark for good, and an open one its chunks. Chunks without an id or a place are left out.
    """
    spark = chunks.sparkSession
    kinds = dict(chunks.dtypes)
    rows = chunks.where("id is not null and seq is not null").select("id", F.col("seq").cast("int").alias("seq"), F.coalesce("last", F.lit(False)).alias("last"), "data", *([F.col(time).alias("time")] if time else []))
    wait = None
    if time:
        wait = int(spark.sql(f"SELECT unix_millis(TIMESTAMP '2000-01-01' + INTERVAL {patience}) - unix_millis(TIMESTAMP '2000-01-01')").first()[0])
        rows = rows.withWatermark("time", "0 seconds")
    joiner = _Joiner(kinds["data"], kinds["data"] == "string", wait)
    out = rows.groupBy("id").transformWithStateInPandas(joiner, f"id {kinds['id']}, data {kinds['data']}, complete boolean", "append", "EventTime" if time else "None")
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # a query keeps the provider it starts with
    try:
        return out.writeStream.format("parquet").option("path", whole).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(_PROVIDER, before)
