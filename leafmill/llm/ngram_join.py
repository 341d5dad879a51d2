"""Near-duplicate documents by exact Jaccard of word shingles (T-occurrence search)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow_text import bounded_batches, chunks, set_keys, shingles, utf8, words
from .components import settle
from .overlap import is_few, link_components
from .postings import SCHEMA, Packer, shared_tokens

HOT_TOKENS = 1 << 16
"""Most shingles that the broadcast list of frequent shingles can hold (half a
megabyte). It only sets the order of a prefix, never which rows are compared."""


NO_ID = -(2**62)
"""Stands for a null doc_id in a join; a text that comes with a wrong key is told by its key."""
TASK_POSTINGS = 1 << 22
"""About as many postings, of 16 bytes each, are sorted in one task."""
SPARE = 16
"""A prefix is longer by a 16th of the set than it must be to share one shingle, so it must share as many."""


def least_shared(percent: int) -> F.Column:
    """Shingles that the prefix of a set of n shares with that of any it links with, whose size is percent * n / 100 or more."""
    return F.greatest(F.lit(1), F.floor(F.floor(F.col("n") * percent / 100) / SPARE))


def _sets(batches, size: int, at: int = 0):
    """(rows of the batch, distinct shingles, offsets) chunk by chunk."""
    for batch in batches:
        data, offs = utf8(batch.column(at))
        for lo, hi in chunks(offs):
            part, inner = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            rows, _, _, hashes = words(part, inner)
            keys, bounds = shingles(rows, hashes, hi - lo, size)
            yield batch, lo, hi, keys, bounds


def _prefixes(keys: np.ndarray, bounds: np.ndarray, percent: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of each set in the order of hashes, frequent shingles last; and the set's number.

    Linked sets of n and m shingles share t >= ceil(percent * max(n, m) / 100),
    so their prefixes of n - t + c and m - t + c have at least c in common.
    Here c is n // SPARE (at least 1), see `least_shared`.
    """
    n_rows = len(bounds) - 1
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(n_rows), sizes)
    frequent = np.isin(keys, hot)
    order = np.lexsort((keys, frequent, owner))
    keys, owner = keys[order], owner[order]
    take = np.where(sizes > 0, sizes - -(-percent * sizes // 100) + np.maximum(sizes // SPARE, 1), 0)
    rank = np.arange(len(keys)) - bounds[owner]
    keep = rank < take[owner]
    return keys[keep], owner[keep]


def _survey(size: int, limit: int):
    """First pass: each row's set key and size, with the hash of its text, and shingles frequent in the task."""

    def run(batches):
        kept_tokens, kept_counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch, lo, hi, keys, bounds in _sets(batches, size, at=1):
            m = hi - lo
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, m), batch.column(2).slice(lo, m), pa.array(set_keys(keys, bounds)), pa.array(np.diff(bounds)), pa.nulls(m, pa.int64())],
                names=["doc_id", "h", "k", "n", "token"],
            )
            kept_tokens = np.concatenate((kept_tokens, keys))
            kept_counts = np.concatenate((kept_counts, np.ones(len(keys), np.int64)))
            if len(kept_tokens) > 8 * limit:
                kept_tokens, kept_counts = _frequent(kept_tokens, kept_counts, 2 * limit)
        tokens, counts = _frequent(kept_tokens, kept_counts, limit)
        tokens, counts = tokens[counts > 2], counts[counts > 2]
        if len(tokens):
            none = pa.nulls(len(tokens), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(counts), pa.array(tokens.view(np.int64))], names=["doc_id", "h", "k", "n", "token"])

    return run


def _frequent(tokens: np.ndarray, counts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts by token; of more than `limit` tokens those with the highest counts."""
    order = np.argsort(tokens, kind="stable")
    tokens, counts = tokens[order], counts[order]
    if not len(tokens):
        return tokens, counts
    starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    tokens, counts = tokens[starts], np.add.reduceat(counts, starts)
    if len(tokens) > limit:
        top = np.argpartition(-counts, limit)[:limit]
        tokens, counts = tokens[top], counts[top]
    return tokens, counts


def _post(size: int, percent: int, buckets: int, shared_hot):
    def run(batches):
        hot = np.frombuffer(shared_hot.value, np.uint64)
        packer, seen = Packer(buckets, hot), set()
        for _, lo, hi, keys, bounds in _sets(batches, size):
            ids = set_keys(keys, bounds)
            tokens, owner = _prefixes(keys, bounds, percent, hot)
            fresh = np.array([not (k in seen or seen.add(k)) for k in ids.tolist()], bool)
            mine = fresh[owner]
            yield from packer.add(tokens[mine], ids[owner[mine]])
        yield from packer.flush()

    return run


def text_sets(size: int):
    """From texts their set keys and sets."""

    def run(texts: list[str], items: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        keys, sets = [np.empty(0, np.int64)], []
        for _, _, _, found, bounds in _sets([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])], size):
            keys.append(set_keys(found, bounds))
            sets += [found[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        return np.concatenate(keys), sets

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: (doc_id, n_shingles, component_id).

    Sets are the distinct `size`-word shingles of the text with A-Z lowered
    (fewer words: the whole sequence). Documents link when 100 * intersection
    >= percent * union; component_id is the least doc_id reachable by links.

    Null and empty texts have no shingles and link with nothing. Rows that
    repeat a doc_id are told apart by nothing but their text: each keeps its
    row. A null doc_id takes part, but never names a component unless all of
    its component's are null. Other columns are ignored. An empty table gives
    an empty table.

    Method: equal sets are one item, keyed by 64 bits of hash. Items that link
    share shingles of their prefixes in any fixed order; frequent shingles come
    last in it. Items whose prefix shares too few with all others together
    cannot link and go; the others are compared by `overlap.link_components`.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    seen = settle(hashed.mapInArrow(_survey(size, HOT_TOKENS), "doc_id long, h long, k long, n long, token long"))
    top = (
        seen.where("token is not null").groupBy("token").agg(F.sum("n").alias("c"))
        .orderBy(F.desc("c"), "token").limit(HOT_TOKENS).select("token").toPandas()["token"]
    )
    hot_bytes = np.sort(top.to_numpy(np.int64).view(np.uint64)).tobytes()
    hot = spark.sparkContext.broadcast(hot_bytes)
    keyed = seen.where("token is null").select("doc_id", "h", "k", "n")
    postings = (keyed.agg(F.sum("n")).first()[0] or 0) * (100 - percent + 100 / SPARE) / 100
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(postings // TASK_POSTINGS))
    blobs = docs.select("text").mapInArrow(_post(size, percent, 8 * tasks, hot), SCHEMA)
    shared = settle(shared_tokens(blobs, np.frombuffer(hot_bytes, np.uint64), tasks))

    # of each set one row's id and text hash, and how many rows have both
    rows = keyed.where("k <> 0").groupBy("k", F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), "h").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.min("doc_id").alias("first"))
    classes = settle(rows.groupBy("k").agg(F.min("first").alias("first"), F.max("n").alias("n"), F.min(F.struct("d", "h", "c")).alias("one")))
    enough = shared.groupBy("k").agg(F.count("*").alias("c")).join(classes, "k").withColumn("need", least_shared(percent))
    shared = settle(shared.join(enough.where("c >= need").select("k", "need", "n"), "k"))

    def texts_of(items: DataFrame) -> DataFrame:
        asked = items.join(classes, "k").select("k", "one.d", "one.h", "one.c")
        asked = settle(asked)
        texts = hashed.withColumn("d", F.coalesce("doc_id", F.lit(NO_ID)))
        found = lambda part: texts.join(F.broadcast(part) if is_few(part) else part, ["d", "h"]).select("k", F.col("text").alias("body"))
        repeated = asked.where("c > 1")
        if repeated.isEmpty():
            return found(asked)
        return found(asked.where("c = 1")).unionByName(found(repeated).dropDuplicates(["k"]))

    roots = link_components(shared, texts_of, text_sets(size), percent)
    linked = classes.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    named = linked.join(linked.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("k", "component_id")
    return keyed.drop("h").join(named, "k", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
