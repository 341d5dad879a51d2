"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import settle

CYCLE = (5.0, 2.0, 1.0)
MOST = 3.0
BINS = 4096
WORDS = r"[^\x20\x09-\x0D]+"
SALT = "mix-1:"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and tab to CR; null: 0."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: tuple[float, ...] = CYCLE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources by code point, null last, weigh `cycle`, repeating. Targets share
    the sum of all sizes by weight; a target stops at `most` times its
    source's size and the excess is shared anew. Its windows put the rows of
    all sources, one a source, into one task, which suits thousands of sources.
    The search ends where every open
    source gets level * weight. Sorted by the level at which a source closes,
    the first source that stays open at its level ends the search.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weights = F.array(*[F.lit(w) for w in cycle])
    s = sizes.withColumn("place", place).withColumn("weight", F.element_at(weights, (F.col("place") % len(cycle) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("closes", F.col("cap") / F.col("weight"))
    order = Window.orderBy("closes", "place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumn("shut", F.coalesce(F.sum("cap").over(order), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    s = s.withColumn("level", (F.sum("source_size").over(whole) - F.col("shut")) / F.col("open"))
    level = F.min(F.when(F.col("level") <= F.col("closes"), F.struct("closes", "place", "level"))).over(whole)["level"]
    s = s.withColumn("target", F.least(F.col("cap"), F.coalesce(level, F.col("closes")) * F.col("weight")))
    return s.select("source", "source_size", "target")


def mix_sources(docs: DataFrame, cycle: tuple[float, ...] = CYCLE, most: float = MOST) -> DataFrame:
    """One row a document: (doc_id, source, th, size, source_size, target, copies).

    A source with target q times its size takes every document floor(q) times
    whole; the rest, a fraction f, is an order sample: documents are ranked by
    random odds u / (1 - u) over inclusion odds f / (1 - f) * sqrt(size / mean
    size), and the ranked documents whose words fit the remaining target are
    taken (the one that crosses it, if it ends nearer to it). u comes from a digest of
    doc_id and text, so reruns agree and no order of rows matters.

    A source's documents are first binned by rank, so no task sorts a whole
    source: the bin where the running sum crosses the target is found from
    sums by bin, and only that bin is ranked row by row.

    A null or empty text has size 0, and is taken as often as its source's
    whole copies (none of its words count). A null source is a source of its
    own, the last. Rows equal in doc_id and text tie; as many are taken as
    fit. th is a hash of the text that tells rows of one doc_id apart. Other
    columns are ignored. An empty table gives an empty table.
    """
    digest = F.md5(F.concat(F.lit(SALT), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    rows = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), u.alias("u"), F.xxhash64("text").alias("th")))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(sums.select("source", "source_size")).join(
        sums.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))
    ).drop("s")
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    targets = targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = targets.withColumn("f", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0))
    targets = settle(targets.withColumnRenamed("source", "s"))

    joined = rows.join(F.broadcast(targets) if _few(targets) else targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    odds = F.col("f") / (1 - F.col("f")) * F.sqrt(F.col("size") * F.col("n") / F.col("source_size"))
    q = (F.col("u") / (1 - F.col("u"))) / odds
    ranked = joined.withColumn("q", F.when((F.col("f") > 0) & (F.col("size") > 0), q / (1 + q)))
    ranked = ranked.withColumn("bin", F.floor(F.col("q") * BINS))
    bins = ranked.where("q is not null").groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("bin_size").over(run), F.lit(0)))
    bins = bins.select(F.col("source").alias("bs"), F.col("bin").alias("bb"), "bin_size", "before")
    placed = ranked.join(bins, F.col("source").eqNullSafe(F.col("bs")) & (F.col("bin") == F.col("bb")), "left")
    inside = placed.where("before + bin_size <= rest").withColumn("extra", F.lit(1))
    beyond = placed.where("q is null or before >= rest").withColumn("extra", F.lit(0))
    crossing = placed.where("before < rest and before + bin_size > rest")
    within = Window.partitionBy("source", "bin").orderBy("q", "doc_id", "th").rowsBetween(Window.unboundedPreceding, 0)
    crossing = crossing.withColumn("after", F.col("before") + F.sum("size").over(within))
    fits = (F.col("after") <= F.col("rest")) | ((F.col("after") - F.col("size") < F.col("rest")) & (F.col("after") - F.col("rest") < F.col("rest") - F.col("after") + F.col("size")))
    crossing = crossing.withColumn("extra", F.when(fits, 1).otherwise(0)).drop("after")
    out = inside.unionByName(beyond).unionByName(crossing)
    return out.select("doc_id", "source", "th", "size", "source_size", "target", (F.col("whole") + F.col("extra")).cast("int").alias("copies"))


def _few(targets: DataFrame, limit: int = 100_000) -> bool:
    """Whether the table of sources is small enough to broadcast."""
    return len(targets.select(F.lit(1)).head(limit + 1)) <= limit


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (CAST('0x' || substr(md5(concat('mix-1:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))), 1, 12) AS BIGINT)::DOUBLE + 0.5)
           / 281474976710656.0 AS u FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source
), w AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM s
), c AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][(place % 3 + 1)::INT]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM w
), l AS (
  SELECT *, cap / weight AS closes,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shut,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open,
    sum(source_size) OVER () AS total FROM c
), m AS (
  SELECT *, (total::DOUBLE - shut) / open AS level FROM l
), v AS (
  SELECT level AS final FROM m WHERE level <= closes ORDER BY closes, place LIMIT 1
), t AS (
  SELECT m.source, m.source_size, m.n, least(m.cap, coalesce((SELECT final FROM v), m.closes) * m.weight) AS target FROM m
), f AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), r AS (
  SELECT *, target - whole * source_size AS rest, CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0 END AS f FROM f
), j AS (
  SELECT d.doc_id, d.size, d.u, r.* EXCLUDE (f), r.f FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
), o AS (
  SELECT *, CASE WHEN f > 0 AND size > 0 THEN (u / (1 - u)) / (f / (1 - f) * sqrt(size::DOUBLE * n / source_size)) END AS q0 FROM j
), p AS (
  SELECT *, q0 / (1 + q0) AS q FROM o
), a AS (
  SELECT *, CASE WHEN q IS NOT NULL THEN sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id ROWS UNBOUNDED PRECEDING) END AS after FROM p
)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN after <= rest OR (after - size < rest AND after - rest < rest - after + size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM a
"""


def query(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
