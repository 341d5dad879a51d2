"""Vectorised text work on the UTF-8 buffers of Arrow string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
CHUNK_BYTES = 1 << 18
BATCH_BYTES = 1 << 23


def bounded_batches(spark) -> None:
    """Holds batches of rows for Python to about BATCH_BYTES in this session.

    Spark's own limit is 64 MB, and a task has several copies of a batch, in
    the JVM and in Python; texts fill it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


KEPT_POWERS = 1 << 19
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, not to be written to; the first KEPT_POWERS of a base are made once."""

    def made(n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)

    if n > KEPT_POWERS:
        return made(n)
    if int(base) not in _POWERS:
        _POWERS[int(base)] = made(KEPT_POWERS)
    return _POWERS[int(base)][:n]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges of about `limit` bytes; a longer row stands alone."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


def words(data: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash) of each run of bytes other than space and tab to CR.

    A polynomial prefix sum over the whole chunk answers each word's hash.
    """
    n = len(data)
    if not n:
        e = np.empty(0, np.int64)
        return e, e, e, np.empty(0, np.uint64)
    solid = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    before = np.concatenate(([False], solid[:-1]))
    starts = np.flatnonzero(solid & (~before | first[:n]))
    after = np.concatenate((solid[1:], [False]))
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[_LOWER[data] if lower else data] * powers(BASE, n), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * powers(INVERSE, n)[starts])
    rows = np.searchsorted(offs, starts, "right") - 1
    return rows, starts, ends, hashes


def shingles(rows: np.ndarray, hashes: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of `size`-word shingles, row after row, and their offsets.

    Fewer words than `size` make one shingle of the whole sequence; none, none.
    """
    per_row = np.bincount(rows, minlength=n_rows)
    begin = np.concatenate(([0], np.cumsum(per_row)))
    multipliers = mix(np.arange(11, 11 + size, dtype=np.uint64)) | np.uint64(1)
    keys, owners = [], []
    if len(hashes) >= size:
        total = np.zeros(len(hashes) - size + 1, np.uint64)
        for j in range(size):
            total += hashes[j : len(hashes) - size + 1 + j] * multipliers[j]
        whole = rows[: len(total)] == rows[size - 1 :]
        keys.append(mix(total[whole]))
        owners.append(rows[: len(total)][whole])
    for k in range(1, size):
        few = np.flatnonzero(per_row == k)
        if len(few):
            total = np.full(len(few), k * int(BASE) % (1 << 64), np.uint64)
            for j in range(k):
                total += hashes[begin[few] + j] * multipliers[j]
            keys.append(mix(total))
            owners.append(few)
    if not keys:
        return np.empty(0, np.uint64), np.zeros(n_rows + 1, np.int64)
    return distinct(np.concatenate(owners), np.concatenate(keys), n_rows)


def distinct(owners: np.ndarray, keys: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of each owner and their offsets."""
    if (owners[1:] < owners[:-1]).any():
        order = np.argsort(owners, kind="stable")
        owners, keys = owners[order], keys[order]
    else:
        keys = keys.copy()
    bounds = np.searchsorted(owners, np.arange(n_rows + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            keys[a:b].sort()
    new = np.ones(len(keys), bool)
    if len(keys):
        new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    return keys[new], np.concatenate(([0], np.cumsum(np.bincount(owners[new], minlength=n_rows)))).astype(np.int64)


def set_keys(keys: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each set of distinct hashes; 0 stands for the empty set."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(keys)))
    total = sums[offs[1:]] - sums[offs[:-1]]
    folds = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(keys ^ BASE))))
    fold = folds[offs[1:]] - folds[offs[:-1]]
    size = np.diff(offs).astype(np.uint64)
    out = mix(mix(total + size * BASE) ^ fold) | np.uint64(1)
    return np.where(size > 0, out, np.uint64(0)).view(np.int64)
