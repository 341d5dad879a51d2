"""Exact top-k search by inner product over an impact-ordered index, score at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .components import settle

SCALE = 64
BLOCK, LEAST_BLOCK = 16_384, 2_048
"""Vectors of a block; where that leaves partitions without a block, blocks are smaller, down to LEAST_BLOCK."""
QUERIES = 128
"""Queries that pass a block at once, so that their sums stay in a core's cache."""
HELD = 2**62
"""Components are exact below this; a larger one is held as this, with its sign. Scores beyond 64 bits likewise."""
EXACT, SINGLE = 2**52, 2**24
"""Sums of whole numbers below these are exact in float64 and float32."""


class ImpactIndex:
    """Postings (dimension, vector, component) of a block of integer vectors in segments of descending impact.

    The quantised impact of a posting is the bit length of its component's
    size. A segment holds the postings of one impact, a run for each dimension
    that has any; components of 0 have none. After a segment two bounds on
    what is left of a score hold: by dimension, the sum of |query| times the
    greatest component left in it; by vector, the length of the query times
    that of the components left (Cauchy and Schwarz).
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order], np.int64)
        rows = np.arange(len(ids)) if rows is None else rows[order]
        self.by_row = np.argsort(rows)
        self.rows = rows[self.by_row]
        size = np.abs(self.vectors)
        self.top = int(size.max(initial=0))
        impact = np.frexp(size.astype(np.float64))[1]
        owner, dim = np.nonzero(size)
        level = impact[owner, dim]
        order = np.lexsort((owner, dim, -level))
        owner, dim, level = owner[order], dim[order], level[order]
        value = self.vectors[owner, dim].astype(np.float64)
        starts = np.flatnonzero(np.concatenate(([True], (level[1:] != level[:-1]) | (dim[1:] != dim[:-1])))) if len(owner) else np.empty(0, np.int64)
        ends = np.append(starts[1:], len(owner))
        self.segments = []
        for low in dict.fromkeys(level.tolist()):
            runs = [(int(dim[a]), owner[a:b], value[a:b]) for a, b in zip(starts, ends) if level[a] == low]
            left = np.where(impact < low, size, 0).astype(np.float64)
            self.segments.append((runs, left.max(axis=0), np.sqrt((left * left).sum(axis=1)) * (1 + 1e-9)))

    def _bounds(self, query: np.ndarray, scores: np.ndarray, left: np.ndarray, lengths: np.ndarray, barred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of each vector, as far as the segments until now tell."""
        slack = np.minimum(np.abs(query) @ left, np.sqrt(query @ query) * (1 + 1e-9) * lengths)
        low, high = scores - slack, scores + slack
        low[barred] = high[barred] = -np.inf
        return low, high

    def _best(self, query: np.ndarray, possible: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of some vectors by their exact scores."""
        wide = self.top * sum(abs(x) for x in query.tolist()) >= HELD
        if wide:
            exact = np.array([max(-HELD * 2, min(HELD * 2 - 1, sum(a * b for a, b in zip(v, query.tolist())))) for v in self.vectors[possible].tolist()], np.int64)
        else:
            exact = self.vectors[possible] @ query
        best = np.lexsort((self.ids[possible], -np.maximum(exact, -(2**63) + 1)))[:k]
        return self.ids[possible][best], exact[best]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the k best of each query, ties to smaller ids; never the query's own row, if it is here."""
        n = len(self.ids)
        at = np.searchsorted(self.rows, own)
        barred = [self.by_row[i : i + 1] if i < n and self.rows[i] == row else self.by_row[:0] for i, row in zip(at.tolist(), own.tolist())]
        out: list = [None] * len(queries)
        waiting = []
        for q, query in enumerate(queries):
            # sums of float64 are exact below EXACT; a query beyond that, or one that all vectors answer, needs no bounds
            if n <= k + 1 or self.top * sum(abs(x) for x in query.tolist()) >= EXACT or not self.segments:
                out[q] = self._best(query, np.delete(np.arange(n), barred[q]), k)
            else:
                waiting.append(q)
        waiting = np.array(waiting, np.int64)
        most = self.top * int(np.abs(queries[waiting]).sum(axis=1).max(initial=0))
        kind = np.float32 if most < SINGLE else np.float64
        scores = np.zeros((n, len(waiting)), kind)
        for at, (runs, left, lengths) in enumerate(self.segments):
            asked = queries[waiting].T.astype(np.float64)
            factors = np.ascontiguousarray(asked, kind)
            for d, owner, value in runs:
                part = scores[owner]
                part += value.astype(kind)[:, None] * factors[d]
                scores[owner] = part
            last = at == len(self.segments) - 1
            stays = np.ones(len(waiting), bool)
            for j, q in enumerate(waiting.tolist()):
                low, high = self._bounds(asked[:, j], scores[:, j].astype(np.float64), left, lengths, barred[q])
                floor = np.partition(low, n - k)[n - k]
                possible = np.flatnonzero((high >= floor) & (high > -np.inf))
                # proof: none of the others can reach the k-th least score; what is possible is scored exactly
                if last or len(possible) <= max(4 * k, n // 4):
                    out[q] = self._best(queries[q], possible, k)
                    stays[j] = False
            waiting, scores = waiting[stays], scores[:, stays]
            if not len(waiting):
                break
        return out


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, row numbers and integer vectors of one length of a batch."""
    return batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).flatten().to_numpy().reshape(len(batch), -1)


def _search(k: int):
    """Over rows (block, dim, asks, vec_id, row, v) in this order: vectors of a block are indexed once, and its queries stream past the index."""

    def run(batches):
        held, parts, index = None, [], None
        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))) if len(keys) else []
            for a, b in zip(starts, np.append(starts[1:], len(keys))):
                block, asks = tuple(keys[a, :2].tolist()), keys[a, 2]
                if block != held:
                    held, parts, index = block, [], None
                ids, rows, vectors = _rows(batch.slice(a, b - a))
                if not asks:
                    parts.append((ids, vectors, rows))
                    continue
                if index is None:
                    if not parts:
                        continue
                    index = ImpactIndex(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
                    parts = []
                for lo in range(0, len(ids), QUERIES):
                    own = rows[lo : lo + QUERIES]
                    found = index.search(vectors[lo : lo + QUERIES], own, k)
                    counts = [len(f[0]) for f in found]
                    columns = np.repeat(ids[lo : lo + QUERIES], counts), np.repeat(own, counts), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "row", "vec_id", "score"])

    return run


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, row, v array<long>): floor(64 * x) of each component, with a number for each row that tells rows of one id apart; a checkpoint, so that the numbers stay. Vectors that are null, empty or hold a null or non-finite component are left out.

    A component of 2**62 or more in size is held as 2**62 with its sign.
    """
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-float(HELD))), F.lit(float(HELD))))
    return settle(embeddings.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & fit).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), F.transform("embedding", held).alias("v")
    ))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of highest inner product for each query row.

    vectors: as of `integer_vectors`; queries: some of its rows. Every row but the
    query's own is a candidate, also one of the same id; fewer than k
    candidates give all of them. Ties go to the smaller vec_id. Vectors of
    another length than a query's are no candidates of it. Rows that repeat a
    vec_id take part as often as they are there, and each that is a query has
    its own k answers. Scores are exact; one beyond 64 bits is given as the
    nearest number of 64 bits, and ties there go by vec_id. An empty table
    gives an empty one.

    Rows are dealt to blocks of bounded size by their numbers. A block is
    indexed once, in one task, and all queries stream past it; so what is moved
    is each vector once and each query once a block.
    """
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = vectors.count()
    n_blocks = max(total // BLOCK, min(n, total // LEAST_BLOCK)) + 1
    block = F.pmod(F.xxhash64("row", F.lit("block")), F.lit(n_blocks)).cast("int")
    own = vectors.select(block.alias("block"), F.size("v").alias("dim"), F.lit(0).alias("asks"), "vec_id", "row", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.size("v").alias("dim"), F.lit(1).alias("asks"), "vec_id", "row", "v")
    met = own.union(asked).repartition(n_blocks, "block").sortWithinPartitions("block", "dim", "asks")
    found = met.mapInArrow(_search(k), "query_id long, row long, vec_id long, score long")
    place = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


SQL = r"""
WITH e AS (
  SELECT vec_id, row_number() OVER () AS no, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.no, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM e q JOIN e c ON q.no <> c.no AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def query(spark, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)
