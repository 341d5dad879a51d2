"""Progress as a stream: the latest row of each book in a table of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.library import latest_progress


FULL = 20
"""Every so many batches a snapshot holds all books; the others hold those of their batch."""


def stream_progress(feed: DataFrame, target: str, checkpoint: str):
    """G1: starts a query that writes each micro-batch's latest rows to target/batch=n, one row a book.

    Of one book the row of the last batch counts, whatever its time, as rows
    count in the order in which they arrive; within a batch the order is that
    of (updated_at, item_id). Every FULL batches all books are written, and
    what is older than the full snapshot before goes. A batch that is run again
    writes the same rows under the same number.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = latest_progress(batch.select("book_id", "item_id", "line_index", "updated_at"))
        old = snapshot(spark, target, below=n) if n % FULL == 0 else None
        if old is not None:
            rows = rows.unionByName(old.join(rows, "book_id", "left_anti"))
        rows.write.mode("overwrite").parquet(f"{target}/batch={n}")
        if n % FULL == 0:
            fs, path, found = _batches(spark, target)
            for m in found:
                if m < n - FULL:
                    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path, f"batch={m}"), True)

    return feed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _batches(spark: SparkSession, target: str):
    """(file system, path, numbers of the batches that are written to their end)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    whole = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, f"{n}/_SUCCESS"))
    return fs, path, sorted(int(n.split("=")[1]) for n in names if n.startswith("batch=") and whole(n))


def snapshot(spark: SparkSession, target: str, below: int | None = None) -> DataFrame | None:
    """The row of each book in the last batch that has one, of batches under `below` if given; None if there is no batch. A batch that is being written, or was left by a crash, does not count."""
    found = [n for n in _batches(spark, target)[2] if below is None or n < below]
    if not found:
        return None
    rows = spark.read.option("basePath", target).parquet(*[f"{target}/batch={n}" for n in found])
    last = F.max(F.struct("batch", "updated_at", "item_id", "line_index")).alias("r")
    return rows.groupBy("book_id").agg(last).select("book_id", "r.item_id", "r.line_index", "r.updated_at")


def stream_timings(feed: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Count and mean of the values in each window, by kind; late rows beyond the watermark are left out."""
    return feed.withWatermark("updated_at", delay).groupBy(F.window("updated_at", width), "kind").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def stream_timing_table(feed: DataFrame, target: str, checkpoint: str):
    """Starts a query that writes the windows that each micro-batch changes to target/batch=n; of one window and kind the last batch counts."""

    def put(batch: DataFrame, n: int) -> None:
        batch.select("window.start", "kind", "n", "mean").write.mode("overwrite").parquet(f"{target}/batch={n}")

    return stream_timings(feed).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def timing_table(spark: SparkSession, target: str) -> DataFrame:
    """(start, kind, n, mean) of each window as it was written last."""
    rows = spark.read.option("basePath", target).parquet(*[f"{target}/batch={n}" for n in _batches(spark, target)[2]])
    return rows.groupBy("start", "kind").agg(F.max(F.struct("batch", "n", "mean")).alias("r")).select("start", "kind", "r.n", "r.mean")
