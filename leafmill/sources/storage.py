"""Tables that cut lineage, in the folder that the cluster names for checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SMALL = 1_000_000
BATCH_BYTES = 1 << 23


def scratch_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where none is set a local session makes a folder of its own; on a cluster, whose executors do not share local folders, that is an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="leafmill-checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint."""
    scratch_folder(df.sparkSession)
    return df.checkpoint()


def bounded_batches(spark: SparkSession) -> None:
    """Holds batches of rows for Python to about BATCH_BYTES in this session; Spark's own limit is 64 MB, of which a worker has several copies."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


class Rounds:
    """The table of an iteration, written anew in each round as Parquet; the one before the last is removed.

    A checkpoint works out its last stage twice, once to count and once to
    write; where a round is one large join this is half of its time.
    """

    def __init__(self, df: DataFrame):
        self.spark, self.root, self.paths = df.sparkSession, f"{scratch_folder(df.sparkSession)}/rounds-{uuid.uuid4()}", []
        self.put(df)

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        df.write.parquet(path)
        self.paths.append(path)
        if len(self.paths) > 2:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[-3])
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        self.df = self.spark.read.schema(df.schema).parquet(path)
        return self.df


def few(df: DataFrame, limit: int = SMALL) -> bool:
    """Whether a table has `limit` rows at most; it is read no further than that."""
    return df.limit(limit + 1).count() <= limit
