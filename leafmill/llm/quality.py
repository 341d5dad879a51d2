"""Quality by attention-based multiple-instance learning over the passages of a text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow_text import bounded_batches, chunks, utf8, words
from .toxicity import _is_held_out, bounded_sample

TRAIN_ROWS = 6_000
"""Most labelled rows that the model is fitted on, the first by a hash of doc_id."""
TRAIN_BYTES = 1 << 15
"""Most bytes of a text that the model is fitted on; 6,000 such texts have about half a million passages, of 320 bytes each."""
PASSAGE_WORDS = 64
N_SHAPES, N_WORDS = 16, 32
N_FEATURES = N_SHAPES + N_WORDS
"""Shares of kinds of bytes and words, and signed counts of words by hash."""
HIDDEN = 12

_CLASS = np.zeros((256, 6), np.float32)  # upper, lower, digit, space, sign, other byte
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b, 5 if _b >= 128 else 0 if _c.isupper() else 1 if _c.islower() else 2 if _c.isdigit() else 3 if _c.isspace() else 4] = 1
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?,;:"]] = True


def passages(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each passage, its features) of texts; a passage is 64 words in a row, a text without words has one of zeros.

    The features are N_SHAPES shares and means of the passage's bytes and
    words, and its words themselves: each adds 1 or -1 to one of N_WORDS sums,
    both by its hash, over the square root of their number.
    """
    n_rows = len(offs) - 1
    rows, starts, ends, hashes = words(data, offs, lower=False)
    per_row = np.bincount(rows, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(per_row)))
    count = np.maximum(-(-per_row // PASSAGE_WORDS), 1)
    owner = np.repeat(np.arange(n_rows), count)
    base = np.concatenate(([0], np.cumsum(count)))
    x = np.zeros((len(owner), N_FEATURES), np.float32)
    if not len(rows):
        return owner, x
    passage = base[rows] + (np.arange(len(rows)) - first[rows]) // PASSAGE_WORDS
    begin = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
    has = passage[begin]
    n = np.diff(np.append(begin, len(rows))).astype(np.float32)
    last = np.append(begin[1:], len(rows)) - 1
    sums = np.concatenate((np.zeros((1, 6), np.float64), np.cumsum(_CLASS[data], axis=0, dtype=np.float64)))
    classes = sums[ends[last]] - sums[starts[begin]]
    size = np.maximum(ends[last] - starts[begin], 1)
    x[has, :6] = classes / size[:, None]
    total = lambda v: np.add.reduceat(v.astype(np.float32), begin)
    lengths = ends - starts
    final, initial = data[ends - 1], data[starts]
    same = np.zeros(len(rows), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    sign = _CLASS[:, 4].astype(bool)
    order = np.lexsort((hashes, passage))
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    x[has, 6] = total(lengths) / n / 10
    x[has, 7] = total(same) / n
    x[has, 8] = np.add.reduceat(fresh.astype(np.float32), begin) / n
    x[has, 9] = total(sign[final] & ~_END[final]) / n
    x[has, 10] = total(_END[final]) / n
    x[has, 11] = total((lengths == 1) & sign[initial]) / n
    x[has, 12] = total(sign[initial] & (lengths > 1)) / n
    x[has, 13] = total(_CLASS[initial, 0]) / n
    x[has, 14] = total((lengths > 1) & (final == ord("!"))) / n
    x[has, 15] = np.log1p(n) / 5
    place = passage * N_WORDS + (hashes >> np.uint64(8)).astype(np.int64) % N_WORDS
    sign = np.where(hashes & np.uint64(1), 1.0, -1.0)
    counts = np.bincount(place, weights=sign, minlength=len(owner) * N_WORDS).reshape(-1, N_WORDS)
    x[has, N_SHAPES:] = counts[has] / np.sqrt(n)[:, None]
    return owner, x


class AttentionModel:
    """Encodes every passage, weighs it by a gated attention, and scores the weighted mean.

    h = tanh(x E + e); a = softmax over a text of ((tanh(h V) * sigmoid(h U)) w);
    score = sigmoid((sum a h) c + b).
    """

    SHAPES = {"E": (N_FEATURES, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, HIDDEN), "U": (HIDDEN, HIDDEN), "w": (HIDDEN,), "c": (HIDDEN,), "b": (1,)}

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {k: rng.normal(0, 0.5 / np.sqrt(s[0]), s) * (len(s) > 1 or k in "wc") for k, s in self.SHAPES.items()}
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)

    def forward(self, owner: np.ndarray, x: np.ndarray, n: int) -> dict:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        raw = (t * s) @ p["w"]
        start = np.searchsorted(owner, np.arange(n))
        raw = np.exp(raw - np.maximum.reduceat(raw, start)[owner])
        a = raw / np.add.reduceat(raw, start)[owner]
        z = np.add.reduceat(a[:, None] * h, start, axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "start": start, "score": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))}

    def gradients(self, owner: np.ndarray, f: dict, y: np.ndarray) -> dict:
        p, n = self.p, len(y)
        d = (f["score"] - y) / n
        g = {"c": f["z"].T @ d, "b": np.array([d.sum()])}
        dz = (d[:, None] * p["c"])[owner]
        da = (dz * f["h"]).sum(axis=1)
        draw = f["a"] * (da - np.add.reduceat(f["a"] * da, f["start"])[owner])
        gate = f["t"] * f["s"]
        g["w"] = gate.T @ draw
        dgate = draw[:, None] * p["w"]
        dt, ds = dgate * f["s"] * (1 - f["t"] ** 2), dgate * f["t"] * f["s"] * (1 - f["s"])
        g["V"], g["U"] = f["h"].T @ dt, f["h"].T @ ds
        dh = f["a"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T
        de = dh * (1 - f["h"] ** 2)
        g["E"], g["e"] = f["x"].T @ de, de.sum(axis=0)
        return g

    def fit(self, owner: np.ndarray, x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.01, seed: int = 6) -> AttentionModel:
        """Adam over shuffled batches of texts."""
        rng, n = np.random.default_rng(seed), len(y)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        bounds = np.searchsorted(owner, np.arange(n + 1))
        m1, m2, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(epochs):
            order = rng.permutation(n)
            for lo in range(0, n, batch):
                part = order[lo : lo + batch]
                sizes = bounds[part + 1] - bounds[part]
                own = np.repeat(np.arange(len(part)), sizes)
                at = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in part])
                f = self.forward(own, x[at], len(part))
                step += 1
                for k, g in self.gradients(own, f, y[part]).items():
                    g = g + 1e-4 * self.p[k]
                    m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.999 * m2[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, score): probability of label 1 for every row; null and empty texts have one empty passage."""

        def run(batches):
            for batch in batches:
                data, offs = utf8(batch.column(1))
                for lo, hi in chunks(offs):
                    owner, x = passages(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                    score = self.forward(owner, x, hi - lo)["score"]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score)], names=["doc_id", "score"])

        return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> AttentionModel:
    """Fits on labels(doc_id, quality) of at most max_rows documents.

    Label 1 means good. Null labels, null ids and labels of absent documents
    count for nothing, and rows that repeat a doc_id count once; without any
    row the model is untrained and scores near one half. Other columns are
    ignored. Texts over TRAIN_BYTES are not fitted on, so what the driver gets
    is bounded; they are scored, by all their passages.
    """

    def features(batches):
        for batch in batches:
            data, offs = utf8(batch.column(0))
            for lo, hi in chunks(offs):
                owner, x = passages(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                bounds = (np.searchsorted(owner, np.arange(hi - lo + 1)) * N_FEATURES).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.ravel()))], names=["y", "x"])

    bounded_batches(docs.sparkSession)
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES)
    rows = bounded_sample(short, labels, "quality", max_rows).mapInArrow(features, "y int, x array<float>").toPandas()
    model = AttentionModel()
    if not len(rows):
        return model
    parts = [np.asarray(v, np.float32).reshape(-1, N_FEATURES) for v in rows["x"]]
    owner = np.repeat(np.arange(len(parts)), [len(v) for v in parts])
    return model.fit(owner, np.concatenate(parts), (rows["y"] > 0).to_numpy(float))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels.where(~_is_held_out(F.col("doc_id"))))
    return model.score(docs).select(
        "doc_id", _is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
