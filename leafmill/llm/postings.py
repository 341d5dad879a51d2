"""Postings (token, item) moved through one shuffle as packed byte blobs.

A row for each posting would cost more than the posting itself, so each map
task packs those of a bucket together; a reduce task unpacks, sorts, and keeps
the tokens that at least two items hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "bucket int, payload binary"


class Packer:
    """Gathers postings of a map task; gives them out as batches of blobs."""

    def __init__(self, buckets: int, hot: np.ndarray, limit: int = 1 << 19):
        self.buckets, self.limit = buckets, limit
        self.hot = hot
        self.tokens, self.items, self.held = [], [], 0

    def add(self, tokens: np.ndarray, items: np.ndarray):
        self.tokens.append(tokens)
        self.items.append(items)
        self.held += len(tokens)
        if self.held >= self.limit:
            yield from self.flush()

    def flush(self):
        if not self.held:
            return
        tokens, items = np.concatenate(self.tokens), np.concatenate(self.items)
        self.tokens, self.items, self.held = [], [], 0
        spread = np.where(np.isin(tokens, self.hot), items.view(np.uint64), tokens)
        bucket = ((spread >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        both = np.stack((tokens, items.view(np.uint64)), axis=1)[order]
        bucket = bucket[order]
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        ends = np.append(starts[1:], len(bucket))
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[starts]), pa.array([both[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())],
            names=["bucket", "payload"],
        )


def shared_tokens(blobs: DataFrame, hot: np.ndarray, tasks: int | None = None) -> DataFrame:
    """(token, k): the postings of tokens that two items or more hold, each once.

    `tasks` should grow with the postings, as a task sorts its share of them;
    without it they are as many as shuffle partitions.

    Postings of hot tokens are spread over all tasks by item, so that no task
    gathers one token's; they pass even where a token has but one item.
    """
    tasks = tasks or int(blobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def reduce(batches):
        parts = [np.frombuffer(p, np.uint64).reshape(-1, 2) for b in batches for p in b.column(1).to_pylist()]
        if not parts:
            return
        both = np.concatenate(parts)
        parts.clear()
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        new = np.ones(len(both), bool)
        new[1:] = (both[1:] != both[:-1]).any(axis=1)
        both = both[new]
        same = both[1:, 0] == both[:-1, 0]
        keep = np.isin(both[:, 0], hot)
        keep[1:] |= same
        keep[:-1] |= same
        both = both[keep].view(np.int64)
        for lo in range(0, len(both), 1 << 16):
            part = both[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], names=["token", "k"])

    return blobs.repartition(tasks, "bucket").mapInArrow(reduce, "token long, k long")
