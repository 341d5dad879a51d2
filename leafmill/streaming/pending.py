"""G3 with late items: what has not met its other side waits in a table that each batch tries again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.urls import url_fingerprint
from .progress import _batches

ITEM, TEXT = "item", "text"


def items_feed(items: DataFrame) -> DataFrame:
    """Items (item_id, url, content_text) as rows of the feed; those that have a text need none."""
    return items.where(F.trim(F.coalesce("content_text", F.lit(""))) == "").select(F.lit(ITEM).alias("kind"), url_fingerprint(F.col("url")).alias("fp"), F.col("item_id").cast("long").alias("item_id"), F.lit(None).cast("string").alias("text"))


def extracts_feed(extracts: DataFrame) -> DataFrame:
    """Extracts (url, text) as rows of the feed; blank ones fill nothing."""
    return extracts.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(F.lit(TEXT).alias("kind"), url_fingerprint(F.col("url")).alias("fp"), F.lit(None).cast("long").alias("item_id"), F.trim("text").alias("text"))


def stream_late_backfill(feed: DataFrame, target: str, checkpoint: str, hold: int = 1000):
    """Starts a query over a feed of items and extracts in any order; fills go to target/filled/batch=n.

    feed: rows of `items_feed` and `extracts_feed`. A batch joins what it
    brings and what waits from before; an item is filled once, by the first
    batch in which it has a text (of several texts the oldest, then the least),
    and then waits no longer. Items and texts without a match wait at
    target/waiting/batch=n for `hold` batches; a text that has filled an item
    waits on, for other items of its address. Rows that repeat an item
    that waits count once; an item that comes anew when it is filled is filled anew. A batch that is run again reads the waiting rows of the batch before
    it and writes the same rows to the same place, so nothing is filled twice
    by a restart.
    """

    def fill(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("kind", "fp", "item_id", "text", F.lit(n).cast("long").alias("since"))
        before = [m for m in _batches(spark, f"{target}/waiting")[2] if m < n]
        if before:
            waited = spark.read.schema(rows.schema).parquet(f"{target}/waiting/batch={before[-1]}")
            rows = rows.unionByName(waited.where(F.col("since") > n - hold))
        items = rows.where(F.col("kind") == ITEM).groupBy("item_id", "fp").agg(F.min("since").alias("since"))
        texts = rows.where(F.col("kind") == TEXT).groupBy("fp").agg(F.min(F.struct("since", "text")).alias("t")).select("fp", "t.since", "t.text")
        filled = items.join(texts.select("fp", "text"), "fp")
        filled.select("item_id", "text").write.mode("overwrite").parquet(f"{target}/filled/batch={n}")
        empty = items.join(texts.select("fp"), "fp", "left_anti")
        waiting = empty.select(F.lit(ITEM).alias("kind"), "fp", "item_id", F.lit(None).cast("string").alias("text"), "since")
        waiting = waiting.unionByName(texts.select(F.lit(TEXT).alias("kind"), "fp", F.lit(None).cast("long").alias("item_id"), "text", "since"))
        waiting.write.mode("overwrite").parquet(f"{target}/waiting/batch={n}")
        fs, path, _ = _batches(spark, f"{target}/waiting")
        for m in before[:-1]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path, f"batch={m}"), True)

    return feed.writeStream.foreachBatch(fill).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def filled(spark: SparkSession, target: str) -> DataFrame | None:
    """(item_id, text) of all items filled so far; None before the first batch."""
    found = _batches(spark, f"{target}/filled")[2]
    return spark.read.parquet(*[f"{target}/filled/batch={n}" for n in found]) if found else None
