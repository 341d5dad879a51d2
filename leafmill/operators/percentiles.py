"""Exact percentiles by selection: counts in ranges of values, and refinement of the range that holds the rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.storage import few, settle

FEW = 10_000
"""Most rows that one task sorts; a key of more is narrowed down to so many first."""
GRID = 500
ACCURACY = 10_000


def exact_percentiles(rows: DataFrame, key: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """(key, q0, q1, ...): of each key and share the nearest-rank percentile, which is the least value with that share of the key's rows at or below it.

    Null and NaN values are left out; a null key is a key. A key of up to FEW
    rows is sorted as it is. Of a larger one a sketch of bounded size gives
    GRID values; the rows between those around the rank are counted exactly,
    and only they are looked at in the next round, until the rank falls on a
    value or FEW rows are left. The sketch only chooses where to cut: a bad
    guess costs a round and no exactness, as each cut takes a value away. No
    task ever holds more than the sketch or FEW rows of a key.
    """
    rows = rows.select(F.col(key).alias("k"), F.col(value).alias("v")).where(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")))
    counts = settle(rows.groupBy("k").agg(F.count("*").alias("n")))
    share = F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("i", "share")
    targets = counts.select("k", "n", share).select("k", "i", F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("n"))).cast("long").alias("rank"), "n", *[F.lit(None).cast(rows.schema["v"].dataType).alias(c) for c in ("low", "high", "found")])
    while not (left := targets.where(f"found is null and n > {FEW}")).isEmpty():
        targets = settle(_narrowed(rows, left).unionByName(targets.where(f"found is not null or n <= {FEW}")))
    place = F.row_number().over(Window.partitionBy("k", "i").orderBy("v"))
    last = _held(rows, targets.where("found is null")).withColumn("place", place).where("place = rank").select("k", "i", F.col("v").alias("found"))
    every = targets.where("found is not null").select("k", "i", "found").unionByName(last)
    wide = every.groupBy("k").agg(*[F.max(F.when(F.col("i") == i, F.col("found"))).alias(f"q{i}") for i in range(len(shares))])
    return wide.withColumnRenamed("k", key)


def _held(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows in each target's range, with the target. A hot key meets a few rows of targets, which are broadcast unless there are too many."""
    t = targets.withColumnRenamed("k", "k_")
    within = F.col("k").eqNullSafe(F.col("k_")) & (F.col("low").isNull() | (F.col("v") >= F.col("low"))) & (F.col("high").isNull() | (F.col("v") <= F.col("high")))
    return rows.join(F.broadcast(t) if few(t) else t, within).drop("k_")


def _narrowed(rows: DataFrame, left: DataFrame) -> DataFrame:
    """The targets with the range between the grid's values around their rank, or with what they look for."""
    grid = F.array(*[F.lit(j / GRID) for j in range(GRID + 1)])
    held = _held(rows, left)
    guesses = held.groupBy("k", "i").agg(F.percentile_approx("v", grid, F.lit(ACCURACY)).alias("g"))
    at = F.col("rank") * GRID / F.col("n")
    pick = lambda j: F.get("g", F.greatest(F.lit(0), F.least(F.lit(GRID), j.cast("int"))))
    same = ["k", "i"]
    cut = left.alias("t").join(guesses.alias("s"), F.col("t.k").eqNullSafe(F.col("s.k")) & (F.col("t.i") == F.col("s.i")))
    cut = settle(cut.select("t.*", pick(F.floor(at) - 1).alias("a"), pick(F.round(at)).alias("m"), pick(F.ceil(at) + 1).alias("b")))
    v, a, m, b = (F.col(c) for c in "vamb")
    parts = {"below": v < a, "left": (v >= a) & (v < m), "same": v == m, "right": (v > m) & (v <= b), "above": v > b}
    sums = [f(F.when(p, v)).alias(f"{name}_{n}") for name, p in parts.items() for n, f in (("n", F.count), ("low", F.min), ("high", F.max))]
    found = _held(rows, cut).groupBy(*same, "rank").agg(*sums)
    out, before = None, F.lit(0)
    for name in parts:
        n = F.col(f"{name}_n")
        piece = F.struct((F.col("rank") - before).alias("rank"), n.alias("n"), F.col(f"{name}_low").alias("low"), F.col(f"{name}_high").alias("high"))
        hit = F.col("rank") <= before + n
        out = F.when(hit, piece) if out is None else out.when(hit, piece)
        before = before + n
    p = found.select(*same, out.alias("p")).select(*same, "p.*")
    return p.select(*same, "rank", "n", "low", "high", F.when(F.col("low") == F.col("high"), F.col("low")).alias("found"))
