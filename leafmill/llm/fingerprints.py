"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow_text import bounded_batches, mix

MODULI = (2147483647, 2147483629)
BASES = (1264589137, 718281828)
WINDOW = 12
SKETCH = 64
LEAST = -(2**63)
RANGES_PER_PARTITION = 8
PARTITION_BYTES = 1 << 26
"""Text that a task of the sort holds, about, where that asks for more tasks than spark.sql.shuffle.partitions."""
SAMPLE_PER_PARTITION = 20


class Powers:
    """Powers of each base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = [np.ones(1, np.int64) for _ in MODULI]
        self.down = [np.ones(1, np.int64) for _ in MODULI]

    def reach(self, n: int) -> None:
        while len(self.up[0]) < n:
            for tables, bases in ((self.up, BASES), (self.down, [pow(b, -1, m) for b, m in zip(BASES, MODULI)])):
                for k, m in enumerate(MODULI):
                    have = tables[k]
                    tables[k] = np.concatenate((have, have * pow(bases[k], len(have), m) % m))


class PrefixHash:
    """Prefix arrays of a text: sums[k][i] is the polynomial hash of its first i code points modulo MODULI[k].

    A span's hash is a difference of two entries, divided by the power at its
    start, so spans of any texts compare at once whatever their places.
    """

    def __init__(self, codes: np.ndarray, powers: Powers, sums: list[np.ndarray] | None = None):
        self.codes, self.powers, self.n = codes, powers, len(codes)
        powers.reach(self.n + 1)
        done = 0 if sums is None else len(sums[0]) - 1
        value = codes[done:].astype(np.int64) + 1
        self.sums = []
        for k, m in enumerate(MODULI):
            tail = np.cumsum(value * powers.up[k][done : self.n] % m)
            head = np.zeros(1, np.int64) if sums is None else sums[k]
            self.sums.append(np.concatenate((head, (tail + head[-1]) % m)))

    def span(self, start: int, end: int) -> tuple[int, ...]:
        return tuple(
            (int(s[end]) - int(s[start])) % m * int(down[start]) % m for s, m, down in zip(self.sums, MODULI, self.powers.down)
        )

    def replaced_tail(self, keep: int, codes: np.ndarray) -> PrefixHash:
        """Hash of the first `keep` code points followed by `codes`; the kept part is not hashed again."""
        return PrefixHash(np.concatenate((self.codes[:keep], codes)), self.powers, [s[: keep + 1] for s in self.sums])

    def common_prefix(self, other: PrefixHash, i: int = 0, j: int = 0) -> int:
        """Longest common extension from places i and j, by binary search over span equality."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(i, i + mid) == other.span(j, j + mid):
                low = mid
            else:
                high = mid - 1
        return low

    def sketch(self, window: int = WINDOW, size: int = SKETCH) -> np.ndarray:
        """The `size` least mixed hashes of all spans of `window` code points (a shorter text: of itself; empty: none)."""
        if not self.n:
            return np.empty(0, np.uint32)
        w = min(window, self.n)
        m, sums = MODULI[0], self.sums[0]
        spans = (sums[w:] - sums[:-w]) % m * self.powers.down[0][: self.n - w + 1] % m
        mixed = (mix(spans.astype(np.uint64) * np.uint64(64) + np.uint64(w)) >> np.uint64(32)).astype(np.uint32)
        if len(mixed) > 8 * size:
            least = np.unique(np.partition(mixed, 4 * size)[: 4 * size])
            if len(least) >= size:
                return least[:size]
        return np.unique(mixed)[:size]

    def fingerprint(self) -> tuple[str, np.ndarray]:
        """(text form, sketch): whole-text hash, length, and the sketch in hex."""
        a, b = self.span(0, self.n)
        sketch = self.sketch()
        return f"{a:08x}{b:08x}:{self.n:x}:{sketch.astype('>u4').tobytes().hex()}", sketch


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Estimated Jaccard index of two texts' spans from their sketches; exact if both hold fewer than `size`. Two empty texts: 1."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    twice = both[1:] == both[:-1]
    # the k-th distinct value ends the union's sketch
    distinct = np.concatenate((both[:1], both[1:][~twice]))
    last = distinct[min(size, len(distinct)) - 1]
    return float((both[1:][twice] <= last).sum() / min(size, len(distinct)))


def _codes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), np.uint32)


def _pairs(batches):
    powers = Powers()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_edited", "common_next"]
    held = None  # (dest, doc_id, text hash object, (fingerprint, sketch)) of the row that waits for its next
    out: list[tuple] = []
    for batch in batches:
        for dest, guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if guest and (held is None or held[0] != dest):
                continue
            mine = PrefixHash(_codes(text), powers)
            name, sketch = mine.fingerprint()
            if held is not None and held[0] == dest:
                _, that_id, that, that_name, that_sketch = held
                cut = that.n // 4
                edited = that.replaced_tail(that.n - cut, mine.codes[:cut])
                edited_name, edited_sketch = edited.fingerprint()
                sha = hashlib.sha256(edited.codes.tobytes().decode("utf-32-le").encode()).hexdigest()
                out.append((that_id, that.n, sha, that_name, edited_name, likeness(that_sketch, edited_sketch), likeness(that_sketch, sketch), that.common_prefix(edited), that.common_prefix(mine)))
            held = None if guest else (dest, doc_id, mine, name, sketch)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) if c[0] is not None else pa.array(c, pa.int64()) for c in map(list, zip(*out))], names=names)
            out = []


def _routes(docs: DataFrame, n: int):
    """Bounds of n ranges of ids, and by range its least id and the range before it that has rows.

    The bounds come from a sample of SAMPLE_PER_PARTITION * n ids at most; the
    least ids are exact. Both are as long as there are partitions.
    """
    ids = docs.select("d")
    total = ids.count()
    if not total:
        return np.empty(0, np.int64), {}, {}
    sample = ids.sample(min(1.0, SAMPLE_PER_PARTITION * n / total), seed=7).limit(2 * SAMPLE_PER_PARTITION * n).toPandas()["d"].to_numpy(np.int64)
    bounds = np.unique(np.quantile(sample, np.linspace(0, 1, n + 1)[1:-1], method="nearest")) if len(sample) else np.empty(0, np.int64)
    place = F.pandas_udf(lambda d: pd.Series(np.searchsorted(bounds, d.to_numpy(np.int64), "right")), "long")
    found = ids.select(place("d").alias("p"), "d").groupBy("p").agg(F.min("d").alias("least")).toPandas().sort_values("p")
    least = dict(zip(found["p"].tolist(), found["least"].tolist()))
    order = list(least)
    return bounds, least, {p: order[i - 1] for i, p in enumerate(order)}


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row a document, with fingerprints of its text and of its edited text.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next (likeness of fingerprints, 0 to 1), common_edited,
    common_next (longest common prefix in code points, by binary search).

    The edited text is the text with its last floor(n_chars / 4) code points
    replaced by as many of the next document's first, or all it has; the next
    document is that of the next doc_id, after the last the first. Rows of one
    doc_id follow each other by a hash of their text; a null doc_id counts as
    less than all others. A null text counts as empty; two empty texts are
    alike (1), an empty and another are not (0). A single row is its own next.
    Other columns are ignored. An empty table gives an empty table.

    Rows are dealt to id ranges and sorted there, so the next document is the
    next row; each range also gets the first row of the range after it.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("d", F.coalesce("doc_id", F.lit(LEAST)))
    n = max(n, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PARTITION_BYTES)
    bounds, least, before = _routes(rows, RANGES_PER_PARTITION * n)

    @F.pandas_udf("array<long>")
    def routes(d: pd.Series) -> pd.Series:
        ids = d.to_numpy(np.int64)
        own = np.searchsorted(bounds, ids, "right")
        return pd.Series([[p, before[p]] if least.get(p) == i else [p] for p, i in zip(own.tolist(), ids.tolist())])

    dealt = rows.select("doc_id", "text", "d", F.posexplode(routes("d")).alias("guest", "dest"))
    dealt = dealt.withColumn("guest", F.col("guest") > 0).repartition(n, "dest").sortWithinPartitions("dest", "guest", "d", F.xxhash64("text"))
    return dealt.select("dest", "guest", "doc_id", "text").mapInArrow(
        _pairs,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
