"""Whitening of embeddings by components that contour integration (FEAST) finds in the exact covariance."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow_text import bounded_batches
from .components import settle

SCALE, OFFSET = 64, 1_000_000
HELD = 1 << 44
COMPONENTS = 16
NODES = 8
GROUP = 6
ROUNDS = 12
BLOCK = 4096
FINER = 1 << 11
EPS = np.finfo(float).eps


def inertia(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above a shift.

    By Sylvester's law, from the signs of the blocks of an L D L^T
    factorisation of a - shift with complete (Bunch-Parlett) pivoting.
    """
    a = a - shift * np.eye(len(a))
    above = 0
    while len(a):
        size = np.abs(a)
        diagonal = size.diagonal()
        i = int(diagonal.argmax())
        at = int(size.argmax())
        if not size.flat[at]:
            break
        if diagonal[i] >= (1 + math.sqrt(17)) / 8 * size.flat[at]:
            pivots = [i]
            above += a[i, i] > 0
        else:
            pivots = list(divmod(at, len(a)))
            above += 1  # its determinant is negative, so one sign of each
        rest = np.delete(np.arange(len(a)), pivots)
        side = a[np.ix_(rest, pivots)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(pivots, pivots)], side.T)
        a = (a + a.T) / 2
    return int(above)


def brackets(a: np.ndarray, least: float, most: float, wanted: int, width: float) -> list[tuple[float, float, int]]:
    """Disjoint (low, high, count), falling, that hold the largest `wanted` eigenvalues in (least, most): halved until each is no wider than `width`, or FINER times that if it holds but one."""
    found, held = [], 0
    open_ = [(least, most, inertia(a, least), 0)]
    while open_ and held < wanted:
        low, high, above_low, above_high = open_.pop()
        n = above_low - above_high
        if not n:
            continue
        if high - low <= width * (FINER if n == 1 else 1):
            found.append((low, high, n))
            held += n
            continue
        middle = (low + high) / 2
        above = inertia(a, middle)
        open_ += [(low, middle, above_low, above), (middle, high, above, above_high)]
    return found


def intervals(found: list[tuple[float, float, int]], least: float, most: float, width: float) -> list[tuple[float, float, int]]:
    """(low, high, count): runs of brackets of about GROUP eigenvalues, cut in the gaps between brackets."""
    out, high, n = [], most, 0
    for k, (low, _, count) in enumerate(found):
        n += count
        below = found[k + 1][1] if k + 1 < len(found) else None
        if below is None:
            out.append((max(least, low - width), high, n))
        elif low - below >= width and (n >= GROUP or low - below >= (high - low) / 4):
            out.append(((low + below) / 2, high, n))
            high, n = (low + below) / 2, 0
    return out


def contour(a: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the eigenvalues of a symmetric matrix in (low, high), of which there are `count`.

    FEAST: Gauss-Legendre quadrature on a circle over the interval sums
    solutions of complex shifted systems into a projection of a subspace onto
    the wanted one, Rayleigh-Ritz takes eigenpairs from it, and these are the
    next subspace. A subspace that does not settle in ROUNDS rounds is widened,
    at last to the whole space, where Rayleigh-Ritz is exact.
    """
    d = len(a)
    centre, radius = (low + high) / 2, (high - low) / 2
    x, w = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi * (x + 1) / 2)
    solves = [(weight * radius * t / 2, (centre + radius * t) * np.eye(d) - a) for weight, t in zip(w, turn)]
    norm = np.abs(a).sum(axis=1).max()
    rng = np.random.default_rng(5)
    size = min(d, 2 * count + 4)
    space = rng.standard_normal((d, size))
    while True:
        settled = 0
        for _ in range(ROUNDS):
            q = sum((c * np.linalg.solve(shifted, space.astype(complex))).real for c, shifted in solves) if size < d else np.eye(d)
            q, s, _ = np.linalg.svd(q, full_matrices=False)
            q = q[:, s > s[0] * EPS * d]
            reduced = q.T @ a @ q
            values, u = np.linalg.eigh((reduced + reduced.T) / 2)
            space = q @ u
            inside = (values > low) & (values < high)
            error = np.abs(a @ space[:, inside] - space[:, inside] * values[inside]).max(initial=0)
            settled = settled + 1 if inside.sum() == count and error <= 64 * EPS * norm else 0
            if settled == 2 or size == d:
                return values[inside], space[:, inside]
            if space.shape[1] < size:
                space = np.hstack((space, rng.standard_normal((d, size - space.shape[1]))))
        size = min(d, 2 * size)
        space = np.hstack((space, rng.standard_normal((d, size - space.shape[1]))))


def principal(v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, vectors as columns) of the `wanted` largest eigenvalues of a covariance, as far as they are positive.

    Inertia counts bracket the eigenvalues and give the intervals; each is
    solved by `contour` and must give as many pairs as its count says. Values
    at rounding of zero are no components.
    """
    d = len(v)
    scale = float(np.abs(v).max(initial=0))
    if not scale:
        return np.empty(0), np.empty((d, 0))
    a = v / scale
    bound = float(np.abs(a).sum(axis=1).max()) * (1 + 1e-9)
    width, floor = bound * 2.0**-24, 8 * d * EPS * bound
    pairs = []
    for low, high, count in intervals(brackets(a, floor, bound, wanted, width), floor, bound, width):
        count = inertia(a, low) - inertia(a, high)
        values, vectors = contour(a, low, high, count)
        if len(values) != count:
            raise RuntimeError(f"{len(values)} of {count} eigenvalues found in an interval")
        pairs.append((values, vectors))
    if not pairs:
        return np.empty(0), np.empty((d, 0))
    values, vectors = np.concatenate([p[0] for p in pairs]), np.hstack([p[1] for p in pairs])
    order = np.argsort(-values, kind="stable")[:wanted]
    vectors = np.linalg.qr(vectors[:, order])[0]  # orthogonal to rounding also over the seams of intervals
    return values[order] * scale, vectors


def _matrix(column, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _gram(z: np.ndarray):
    """Exact z.T @ z of whole numbers: by floats or 64 bits where these hold it, else by numbers of any size."""
    most = int(np.abs(z).max(initial=0)) ** 2 * max(1, len(z))
    if most < 1 << 53:
        f = z.astype(float)
        return (f.T @ f).astype(np.int64)
    z = z if most < 1 << 62 else z.astype(object)
    return z.T @ z


def _totals(df: DataFrame, d: int, cell: str, cells: Callable[[np.ndarray], list], kind: str) -> dict[int, object]:
    """Number of a `cell` to its sum over all rows of x; `cells` gives a list of as many numbers for each block of rows.

    Each task sends on one row a cell, so what the driver gets is as long as
    there are cells, whatever the number of rows.
    """
    arrow = pa.decimal128(38, 0) if kind.startswith("decimal") else pa.float64()

    def run(batches):
        total = None
        for batch in batches:
            x = _matrix(batch.column(0), d)
            for lo in range(0, len(x), BLOCK):
                part = cells(x[lo : lo + BLOCK])
                total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(total, arrow)], names=[cell, "value"])

    found = df.select("x").mapInArrow(run, f"{cell} long, value {kind}").groupBy(cell).agg(F.sum("value").alias("value"))
    return {r[cell]: r["value"] for r in found.collect()}


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x array<long>): floor(64 * c) + 1000000 of each component; vectors that are null or hold a null or non-finite component are left out.

    64 * c is held to +-2**44. An array column of any number type will do.
    """
    fit = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    held = lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-float(HELD))), F.lit(float(HELD)))) + OFFSET
    return embeddings.where(F.col("embedding").isNotNull() & fit).select("vec_id", F.transform("embedding", held).alias("x"))


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Whitening:
    """Moments of the fit list and its components; `apply` gives rows of SCHEMA.

    The moments are exact: whole numbers are centred at the whole number next
    to their mean before they are multiplied, and the rest of the mean is taken
    off in numbers of any size. The driver gets d sums and d * (d + 1) / 2
    products of d-dimensional vectors.
    """

    def __init__(self, fit: DataFrame, d: int, wanted: int = COMPONENTS):
        sums = _totals(fit, d, "dimension", lambda x: [len(x), *x.astype(object).sum(axis=0)], "decimal(38,0)")
        self.d, self.n = d, int(sums[0])
        n, s = self.n, [int(sums[k + 1]) for k in range(d)]
        self.centre = centre = np.array([(2 * t + n) // (2 * n) for t in s], np.int64)
        self.rest = [t - n * int(c) for t, c in zip(s, centre)]
        upper = np.triu_indices(d)
        products = _totals(fit, d, "product", lambda x: [int(p) for p in _gram(x - centre)[upper]], "decimal(38,0)")
        v, trace = np.zeros((d, d)), 0
        for cell, (i, j) in enumerate(zip(*(u.tolist() for u in upper))):
            exact = n * int(products[cell]) - self.rest[i] * self.rest[j]
            v[i, j] = v[j, i] = exact / n**2
            trace += exact if i == j else 0
        self.values, self.vectors = principal(v, wanted)
        self.explained = self.values / (trace / n**2) if trace else self.values
        k = len(self.values)
        project = self.projection()
        if not k:
            self.identity_error = 0.0
            return

        def cells(x):
            w = project(x)
            return [*w.sum(axis=0).tolist(), *(w.T @ w).ravel().tolist()]

        got = _totals(fit, d, "moment", cells, "double")
        mean = np.array([got[c] for c in range(k)]) / n
        second = np.array([got[k + c] for c in range(k * k)]).reshape(k, k) / n
        self.identity_error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())

    def projection(self) -> Callable[[np.ndarray], np.ndarray]:
        centre, off, scaled = self.centre, np.array([r / self.n for r in self.rest]), self.vectors / np.sqrt(self.values)
        return lambda x: ((x - centre).astype(float) - off) @ scaled

    def deviations(self) -> Callable[[np.ndarray], list]:
        """The sum over dimensions of (n * x - S)**2, exact; null where 64 bits do not hold it."""
        n, centre, rest, d = self.n, self.centre, self.rest, self.d

        def run(x: np.ndarray) -> list:
            z = x - centre
            if d * ((int(np.abs(z).max(initial=0)) + 1) * n) ** 2 < 1 << 63:
                return ((n * z - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
            exact = ((n * z.astype(object) - np.array(rest, object)) ** 2).sum(axis=1).tolist()
            return [t if t < 1 << 63 else None for t in exact]

        return run

    def apply(self, vectors: DataFrame) -> DataFrame:
        project, deviations, explained, error, n, d = self.projection(), self.deviations(), self.explained, self.identity_error, self.n, self.d

        def run(batches) -> Iterator[pa.RecordBatch]:
            k = len(explained)
            for batch in batches:
                x, ids = _matrix(batch.column(1), d), batch.column(0)
                for lo in range(0, len(x) if k else 0, BLOCK):
                    part = x[lo : lo + BLOCK]
                    m = len(part)
                    rows = pa.array(np.repeat(np.arange(lo, lo + m), k))
                    deviation = pa.array(deviations(part), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                    columns = [
                        ids.take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation,
                        pa.array(project(part).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, SCHEMA)


def whiten(embeddings: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """Rows of SCHEMA: each vector's whitened coordinate on each principal component, up to `wanted`.

    Vectors that are null, or hold a null or non-finite component, are left
    out. All must be of one length: those of another than most have (of equally
    frequent ones the longest) are left out too. Rows that repeat a vec_id, and
    rows of a null one, each keep their rows; a vector that repeats counts once
    in the fit list. Components without variance (fewer distinct vectors than
    dimensions) are left out, so one distinct vector, or none, gives no rows.
    `deviation` is null where it needs more than 64 bits. Other columns are
    ignored.
    """
    spark = embeddings.sparkSession
    bounded_batches(spark)
    vectors = whole_vectors(embeddings)
    lengths = vectors.groupBy(F.size("x").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], SCHEMA)
    vectors = vectors.where(F.size("x") == lengths["d"])
    fit = settle(vectors.select("x").distinct())
    return Whitening(fit, lengths["d"], wanted).apply(vectors)


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
