"""Streams that are run to their end over the given tables, with SQL for what they must leave; `registry` imports this module last.

A stream reads a folder that grows: the rows of a table are written to it in
several parts, each of which is a micro-batch.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources import tables as S
from ..sources.storage import scratch_folder
from ..streaming import idle, pending, progress
from .registry import _add

PARTS = 3


def _arriving(spark: SparkSession, rows: DataFrame, parts: list[Column]) -> tuple[str, DataFrame]:
    """(folder, stream) of rows that arrive part by part."""
    folder = f"{scratch_folder(spark)}/stream-{uuid.uuid4()}"
    for part in parts:
        rows.where(part).write.mode("append").parquet(f"{folder}/in")
    files = sum(1 for _ in spark.read.parquet(f"{folder}/in").inputFiles())
    per_part = max(1, -(-files // len(parts)))
    return folder, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_part).parquet(f"{folder}/in")


def _by_time(rows: DataFrame, time: str) -> list[Column]:
    """Conditions that cut a table into PARTS parts of equal spans of time, in order."""
    seconds = F.unix_micros(F.col(time).cast("timestamp"))
    low, high = rows.agg(F.min(seconds), F.max(seconds)).first()
    if low is None:
        return [F.lit(True)]
    cuts = [low + (high - low + 1) * k // PARTS for k in range(1, PARTS)]
    bounds = [(None, *cuts[:1])] + [(a, b) for a, b in zip(cuts, [*cuts[1:], None])]
    return [(F.lit(True) if a is None else seconds >= a) & (F.lit(True) if b is None else seconds < b) for a, b in bounds]


@contextmanager
def _state_in_rocksdb(spark: SparkSession):
    """transformWithState keeps its state there; the session's own setting comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, idle.PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@_add("g1_stream_latest", "SELECT * FROM v_latest")
def _(spark, d):
    feed = S.progress_feed(spark, d)
    folder, stream = _arriving(spark, feed, _by_time(feed, "updated_at"))
    progress.stream_progress(stream, f"{folder}/out", f"{folder}/check").awaitTermination()
    return progress.snapshot(spark, f"{folder}/out")


_IDLE = 2 * 3600 * 1000


def _throttled(spark, d, reason: Column) -> DataFrame:
    feed = S.progress_feed(spark, d).withColumn("reason", reason)
    folder, stream = _arriving(spark, feed, _by_time(feed, "updated_at"))
    with _state_in_rocksdb(spark):
        kept = idle.stream_throttle_idle(stream, 10, _IDLE)
        kept.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("book_id", "item_id", "line_index", "reason")


def _throttled_sql(reason: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT book_id, item_id, line_index, epoch_ms(updated_at) AS ms, {reason} AS reason, row_number() OVER w AS no, coalesce(epoch_ms(updated_at) - epoch_ms(lag(updated_at) OVER w) >= {_IDLE}, true) AS fresh FROM v_feed WINDOW w AS (PARTITION BY book_id ORDER BY updated_at, item_id)),
  r AS (SELECT book_id, no, reason <> 'deleted' AS ok, CASE WHEN reason <> 'deleted' THEN ms END AS last_ms, line_index AS last_line FROM e WHERE no = 1
    UNION ALL SELECT book_id, no, ok, CASE WHEN gone THEN NULL WHEN ok THEN ms WHEN fresh THEN NULL ELSE last_ms END, CASE WHEN ok THEN line_index ELSE last_line END FROM (
      SELECT e.book_id, e.no, e.ms, e.line_index, e.fresh, r.last_ms, r.last_line, e.reason = 'deleted' AS gone, e.reason <> 'deleted' AND (e.reason = 'pause' OR e.fresh OR r.last_ms IS NULL OR (e.line_index <> r.last_line AND (e.ms - r.last_ms >= 1500 OR abs(e.line_index - r.last_line) >= 60))) AS ok FROM r JOIN e ON e.book_id = r.book_id AND e.no = r.no + 1))
  SELECT e.book_id, e.item_id, e.line_index, e.reason FROM e JOIN r USING (book_id, no) WHERE r.ok"""


@_add("g2_stream_throttled", _throttled_sql("CASE WHEN item_id % 50 = 0 THEN 'pause' ELSE 'tick' END"))
def _(spark, d):
    return _throttled(spark, d, F.when(F.col("item_id") % 50 == 0, "pause").otherwise("tick"))


@_add("g5_cleared_progress", _throttled_sql("CASE WHEN item_id % 11 = 0 THEN 'deleted' WHEN item_id % 50 = 1 THEN 'unmount' ELSE 'tick' END").replace("= 'pause'", "= 'unmount'"))
def _(spark, d):
    i = F.col("item_id")
    return _throttled(spark, d, F.when(i % 11 == 0, "deleted").when(i % 50 == 1, "unmount").otherwise("tick"))


@_add("g3_late_backfill", """SELECT page_id AS item_id, 'text ' || page_id AS text FROM pages WHERE page_id % 4 > 0 AND page_id % 5 > 0""")
def _(spark, d):
    """Texts of some pages come before their items, others after; every fifth page has no text, every fourth item has one already."""
    pages = S.table(spark, d, "pages").select("page_id")
    address = F.concat(F.lit("https://b.example/p/"), "page_id")
    texts = pages.where("page_id % 5 > 0").select((F.col("page_id") % 2 * 2).alias("part"), F.concat(address, F.lit("?utm_source=feed")).alias("url"), F.concat(F.lit(" text "), "page_id").alias("text"))
    again = texts.select(F.lit(2).alias("part"), "url", F.lit("a text that comes too late").alias("text")).where(F.col("url").rlike(r"[02468]\?"))
    items = pages.select(F.lit(1).alias("part"), F.col("page_id").alias("item_id"), address.alias("url"), F.when(F.col("page_id") % 4 == 0, "old").otherwise(" ").alias("content_text"))
    rows = texts.unionByName(again).unionByName(items, allowMissingColumns=True)
    parts = [F.col("part") == k for k in range(3)]
    folder, stream = _arriving(spark, rows, parts)
    feed = pending.items_feed(stream.where("item_id is not null")).unionByName(pending.extracts_feed(stream.where("item_id is null")))
    pending.stream_late_backfill(feed, f"{folder}/out", f"{folder}/check").awaitTermination()
    return pending.filled(spark, f"{folder}/out")


def _timings(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("ts").cast("timestamp").alias("updated_at"), F.col("event_type").alias("kind"), "value")


@_add("g4_stage_timings", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type AS kind, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def _(spark, d):
    rows = _timings(S.table(spark, d, "events"))
    folder, stream = _arriving(spark, rows, _by_time(rows, "updated_at"))
    progress.stream_timing_table(stream, f"{folder}/out", f"{folder}/check").awaitTermination()
    return progress.timing_table(spark, f"{folder}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n", F.round("mean", 6).alias("mean"))


