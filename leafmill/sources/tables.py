"""The given tables, and the views of them that stand in for the library's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals a table of fewer splits than there are cores to all of them, so that costly work on its rows is not left to a few; a larger one stays as it is read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def _changed(key: str) -> Column:
    """A time that stands in for the last change of a row."""
    return F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, {key}, 0)")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as roots, nations below them."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("title"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").cast("long").alias("order_index"), _changed("r_regionkey").alias("updated_at"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("title"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_nationkey").cast("long").alias("order_index"), _changed("n_nationkey").alias("updated_at"))
    return r.unionByName(n)


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("title"), F.when(F.col("c_mktsegment") < "F", "file").otherwise("url").alias("source_type"), F.concat(F.lit("n"), "c_nationkey").alias("group_id"), _changed("c_custkey").alias("updated_at"))


def progress_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("book_id"), F.col("event_id").alias("item_id"), F.floor("value").cast("int").alias("line_index"), F.col("ts").alias("updated_at"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("order_index"), F.col("role").alias("title"), F.col("text").alias("content_text"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of groups that grows with the customers: eight below each."""
    k = F.col("c_custkey").cast("long")
    parent = F.when(k > 0, F.concat(F.lit("c"), F.floor((k - 1) / 8)))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), k).alias("id"), F.col("c_name").alias("title"), parent.alias("parent_id"), k.alias("order_index"))


SQL = """
v_tree AS (
  SELECT concat('c', c_custkey) AS id, c_name AS title, CASE WHEN c_custkey > 0 THEN concat('c', (c_custkey - 1) // 8) END AS parent_id, c_custkey::BIGINT AS order_index FROM customer
), v_closure AS (
  SELECT id AS root, id, 0 AS depth FROM v_tree UNION ALL SELECT c.root, t.id, c.depth + 1 FROM v_closure c JOIN v_tree t ON t.parent_id = c.id
), v_groups AS (
  SELECT concat('r', r_regionkey) AS id, r_name AS title, CAST(NULL AS VARCHAR) AS parent_id, r_regionkey::BIGINT AS order_index, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * r_regionkey AS updated_at FROM region
  UNION ALL SELECT concat('n', n_nationkey), n_name, concat('r', n_regionkey), n_nationkey::BIGINT, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * n_nationkey FROM nation
), v_books AS (
  SELECT c_custkey::BIGINT AS id, c_name AS title, CASE WHEN c_mktsegment < 'F' THEN 'file' ELSE 'url' END AS source_type, concat('n', c_nationkey) AS group_id, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * c_custkey AS updated_at FROM customer
), v_feed AS (
  SELECT user_id AS book_id, event_id AS item_id, CAST(floor(value) AS INT) AS line_index, ts AS updated_at FROM events
), v_items AS (
  SELECT conv_id AS book_id, turn AS order_index, role AS title, text AS content_text FROM conversations
), v_latest AS (
  SELECT book_id, item_id, line_index, updated_at FROM v_feed QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY updated_at DESC, item_id DESC) = 1
)"""
