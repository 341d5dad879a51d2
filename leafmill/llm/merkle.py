"""A Merkle manifest of a dataset: blocks of hash trees in van Emde Boas order, trees of their roots, proofs and verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import settle
from .overlap import is_few

HEIGHT = 10
"""Levels of digests over the leaves of a block, which has 2**HEIGHT leaves at most."""
ROWS_PER_RANGE = 100_000
FEW_PATHS = 10_000
"""Most paths, of about 66 bytes a level, that are broadcast; more are joined by a shuffle."""
TAMPERED = 7


def address(height: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Slots of nodes (depth, index) of a complete tree with `height` levels of edges, in van Emde Boas order.

    The tree is cut at half its height; the top tree comes first, then the
    bottom trees from left to right, each laid out in the same way.
    """
    base = np.zeros(len(index), np.int64)
    index = np.asarray(index, np.int64)
    while height:
        top = (height - 1) // 2  # levels of edges inside the top tree; one more joins it to the bottom trees
        bottom = height - top - 1
        if depth <= top:
            height = top
            continue
        depth -= top + 1
        base += (1 << (top + 1)) - 1 + (index >> depth) * ((1 << (bottom + 1)) - 1)
        index = index & ((1 << depth) - 1)
        height = bottom
    return base


@lru_cache(maxsize=64)
def _slots(height: int, depth: int) -> np.ndarray:
    return address(height, depth, np.arange(1 << depth))


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height_of(leaves: int) -> int:
    """Levels until one node remains."""
    return max(0, leaves - 1).bit_length()


def build(leaves: list[str], height: int) -> bytes:
    """The tree over a block's digests, 32 bytes a slot. Slots of nodes that are not there stay zero.

    A node without a right neighbour is hashed alone, up to the height.
    """
    slots = np.zeros((1 << (height + 1)) - 1, "V32")
    level = leaves
    for depth in range(height, -1, -1):
        slots[_slots(height, depth)[: len(level)]] = np.frombuffer(bytes.fromhex("".join(level)), "V32")
        if depth:
            level = [digest(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return slots.tobytes()


def siblings(nodes: bytes, height: int, leaves: int) -> Iterator[list[str]]:
    """Level by level from the leaves up: for each leaf the digest beside its ancestor, after l or r for its side, or nothing where it has none."""
    slots = np.frombuffer(nodes, "V32")
    at, count = np.arange(leaves), leaves
    for depth in range(height, 0, -1):
        beside = at ^ 1
        there = beside < count
        digests = slots[address(height, depth, np.where(there, beside, 0))].tobytes().hex()
        yield [("l" if i & 1 else "r") + digests[64 * k : 64 * k + 64] if t else "" for k, (i, t) in enumerate(zip(at.tolist(), there.tolist()))]
        at, count = at >> 1, (count + 1) >> 1


def fold(leaf: str, path: list[str]) -> str:
    for step in path:
        leaf = digest(leaf) if not step else digest(step[1:], leaf) if step[0] == "l" else digest(leaf, step[1:])
    return leaf


def field(c: Column) -> Column:
    """A value as it goes into a leaf: - for null, else its bytes of UTF-8, a colon and itself."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def _numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds `at`, the place of each row among those of its `tree` in the order of `by`, and `total`, their number.

    Rows are sorted over ranges and counted by range and tree; the sums of
    those counts are where a range's rows of a tree begin. Equal rows are told
    apart by a number, so that a range never has to hold all of them.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // ROWS_PER_RANGE)
    order = [F.col(c).asc_nulls_first() for c in ("tree", *by, "row_")]
    dealt = rows.withColumn("row_", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = f"tree string, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema if f.name != 'tree')}, place long"

    def count(batches):
        held, n = None, 0
        for batch in batches:
            trees = batch.column(0)
            places = np.empty(len(trees), np.int64)
            codes = trees.dictionary_encode(null_encoding="encode")
            run = codes.indices.to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))) if len(run) else []
            for a, b in zip(starts, [*starts[1:], len(run)]):
                tree = codes.dictionary[int(run[a])].as_py()
                if (tree,) != held:
                    held, n = (tree,), 0
                places[a:b] = np.arange(n, n + b - a)
                n += b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places)], names=[*batch.schema.names, "place"])

    names = ["tree", *(c for c in rows.columns if c != "tree")]
    placed = settle(dealt.select(*names).mapInArrow(count, schema).withColumn("range", F.spark_partition_id()))
    counts = placed.groupBy("tree", "range").agg(F.count("*").alias("c"))
    all_of, before = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(counts.select(F.col("tree").alias("tree_"), F.col("range").alias("range_"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"), F.sum("c").over(all_of).alias("total")))
    same = (F.col("range") == F.col("range_")) & F.col("tree").eqNullSafe(F.col("tree_"))
    return placed.join(F.broadcast(starts) if is_few(starts) else starts, same).select(*names, (F.col("place") + F.col("start")).alias("at"), "total")


def blocks(leaves: DataFrame) -> list[DataFrame]:
    """The blocks of all trees, one table a level from the leaves up.

    leaves: (tree, at, total, leaf, item). Each block is a row: tree, block (its
    number), total (nodes of its tree on this level), size, height, items (of
    its leaves), nodes (its digests in van Emde Boas order), root. The roots of
    the blocks of a tree are the leaves of its blocks on the next level, until
    one block holds them all.
    """

    @F.pandas_udf("binary")
    def built(leaves: pd.Series, heights: pd.Series) -> pd.Series:
        return pd.Series([build(list(x), h) for x, h in zip(leaves, heights)])

    out, full = [], 1 << HEIGHT
    while True:
        held = F.array_sort(F.collect_list(F.struct("at", "leaf", "item")))
        level = leaves.groupBy("tree", F.shiftright("at", HEIGHT).alias("block"), "total").agg(held.alias("rows"))
        high = F.when(F.col("total") >= full, HEIGHT).otherwise(F.length(F.bin(F.greatest(F.col("total") - 1, F.lit(0)))) - (F.col("total") <= 1).cast("int"))
        level = level.select("tree", "block", "total", F.size("rows").alias("size"), high.cast("int").alias("height"), F.col("rows.item").alias("items"), F.col("rows.leaf").alias("leaves"))
        level = level.withColumn("nodes", built("leaves", "height")).drop("leaves")
        out.append(settle(level.withColumn("root", F.lower(F.hex(F.substring("nodes", 1, 32))))))
        if out[-1].where(F.col("total") > full).isEmpty():
            return out
        leaves = out[-1].where(F.col("total") > full).select("tree", F.col("block").alias("at"), F.ceil(F.col("total") / full).alias("total"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("item"))


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, root) of each tree: of the block that is alone on its level."""
    tops = [level.where(F.col("total") <= 1 << HEIGHT).select("tree", "root") for level in levels]
    out = tops[0]
    for top in tops[1:]:
        out = out.union(top)
    return out


def _below(level: DataFrame, above: DataFrame | None) -> DataFrame:
    """(tree, at, item, path): for each leaf of a level's blocks its siblings up to the root of its tree, and on from there as `above` (tree, block, path) says."""

    @F.pandas_udf("array<array<string>>")
    def paths(nodes: pd.Series, heights: pd.Series, sizes: pd.Series, above: pd.Series) -> pd.Series:
        return pd.Series([[[*own, *rest] for own in zip(*siblings(n, h, s))] if h else [list(rest)] * s for n, h, s, rest in zip(nodes, heights, sizes, above)])

    each = _with_path(level, above).select("tree", "block", F.posexplode(F.arrays_zip("items", paths("nodes", "height", "size", "path").alias("path"))).alias("place", "leaf"))
    return each.select("tree", (F.shiftleft("block", HEIGHT) + F.col("place")).alias("at"), F.col("leaf.items").alias("item"), F.col("leaf.path").alias("path"))


def _with_path(level: DataFrame, above: DataFrame | None) -> DataFrame:
    if above is None:
        return level.withColumn("path", F.array().cast("array<string>"))
    above = above.select(F.col("tree").alias("tree_"), F.col("at").alias("block_"), "path")
    same = F.col("tree").eqNullSafe(F.col("tree_")) & (F.col("block") == F.col("block_"))
    return level.join(F.broadcast(above) if is_few(level, FEW_PATHS) else above, same, "left").drop("tree_", "block_").withColumn("path", F.coalesce("path", F.array().cast("array<string>")))


def _tops(level: DataFrame, over: DataFrame) -> DataFrame:
    """(tree, at, path) for the blocks of a level that are alone in their tree: the path from the tree's root on."""
    alone = level.where(F.col("total") <= 1 << HEIGHT).select("tree", F.col("block").alias("at"))
    few = is_few(over, FEW_PATHS)
    over = over.select(F.col("tree").alias("tree_"), "path")
    return alone.join(F.broadcast(over) if few else over, F.col("tree").eqNullSafe(F.col("tree_"))).select("tree", "at", "path")


class Manifest:
    """Trees of the leaves of each group, and a tree of their roots.

    leaves: (tree string, key, leaf, item); a tree's leaves stand in the order
    of key, a null one first, then of leaf; `item` comes back with the proofs.
    Trees stand in the order of their names' UTF-8 bytes, null first.
    """

    def __init__(self, leaves: DataFrame):
        self.levels = blocks(_numbered(leaves, ["key", "leaf"]).select("tree", "at", "total", "leaf", "item"))
        self.subroots = settle(roots(self.levels).withColumnRenamed("root", "subroot"))
        crown = self.subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("leaf"))
        crown = _numbered(crown, ["name"]).select("tree", "at", "total", "leaf", F.col("name").alias("item"))
        self.crown = blocks(crown)
        self.root = roots(self.crown).select("root")

    def _over(self) -> DataFrame:
        """(tree, path) from each tree's subroot to the root."""
        above = None
        for level in reversed(self.crown):
            found = _below(level, above)
            above = found.select("tree", "at", "path")
        return settle(found.select(F.col("item").alias("tree"), "path"))

    def proofs(self) -> DataFrame:
        """The blocks of leaves with the path that all leaves of a block share from its root to the root of all, with subroot and root."""
        over, above = self._over(), None
        for level in reversed(self.levels[1:]):
            tops = _tops(level, over)
            above = settle(_below(level, tops if above is None else tops.union(above)).select("tree", "at", "path"))
        tops = _tops(self.levels[0], over)
        met = _with_path(self.levels[0].drop("root"), tops if above is None else tops.union(above))
        subroots = self.subroots.select(F.col("tree").alias("tree_"), "subroot")
        met = met.join(F.broadcast(subroots) if is_few(subroots) else subroots, F.col("tree").eqNullSafe(F.col("tree_"))).drop("tree_")
        return met.crossJoin(F.broadcast(self.root))  # one row


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = {name: batch.column(name) for name in batch.schema.names}
        for k in range(len(batch)):
            nodes, height, items, rest, subroot, root = (columns[c][k].as_py() for c in ("nodes", "height", "items", "path", "subroot", "root"))
            digests = np.frombuffer(nodes, "V32")[address(height, height, np.arange(len(items)))].tobytes().hex()
            shared = "".join(step[1:] for step in rest)
            out = {c: [] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")}
            for i, (item, own) in enumerate(zip(items, zip(*siblings(nodes, height, len(items))) if height else [()] * len(items))):
                leaf = digests[64 * i : 64 * i + 64]
                folded = fold(item["claim"] or leaf, [*own, *rest])
                proof = digest(*[step[1:] for step in own], shared)
                for c, v in zip(out, (item["doc_id"], leaf, subroot, root, proof, folded, folded == root)):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), *[pa.array(out[c]) for c in list(out)[1:]]], names=list(out))


SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def verify_documents(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """Rows of SCHEMA: each document's leaf, its tree's and the whole root, a digest of its proof, and the root folded from what is claimed of it.

    A leaf is the sha256 of doc_id, source, lang, n_chars and text; documents
    of one lang make a tree in the order of doc_id (null first; rows of one
    doc_id in the order of their leaves, so rows that repeat have neighbouring
    leaves). `claimed` is the leaf that a holder of the document presents, null
    where it is the document's own; `verified` says whether it folds to the
    root. Nulls, empty and long texts are hashed as they are; a null lang is a
    tree of its own. Other columns are ignored. An empty table gives an empty
    table.

    What moves is a digest a document; texts are hashed where they are read.
    """
    parts = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    claim = F.lit(None).cast("string") if claimed is None else claimed
    key = F.col("doc_id").cast("long")
    leaves = settle(docs.select(F.col("lang").cast("string").alias("tree"), key.alias("key"), leaf_of(*parts).alias("leaf"), F.struct(key.alias("doc_id"), claim.alias("claim")).alias("item")))
    return Manifest(leaves).proofs().select("nodes", "height", "items", "path", "subroot", "root").mapInArrow(_verify, SCHEMA)


def tampered_leaf() -> Column:
    """The leaf with one more in n_chars, where TAMPERED divides the crc32 of doc_id."""
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    leaf = leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), more, F.col("text"))
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, leaf)


SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    n_chars::HUGEINT AS n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail,
    4294967295 - list_reduce(list_concat([4294967295::BIGINT], [ord(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
      lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT FOR z IN range(8)]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS crc
  FROM documents
), hashed AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN crc % 7 = 0 THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS claim
  FROM docs
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM hashed
), tree(lang, level, i, n, h) AS (
  SELECT lang, 0, i, n, leaf FROM leaves
  UNION ALL SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lang, level, i // 2, n
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1
), crown(level, i, n, h) AS (
  SELECT 0, i, n, subroot FROM subroots
  UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM crown WHERE n > 1 GROUP BY level, i // 2, n
), nodes AS (
  SELECT 0 AS part, lang, level, i, n, h FROM tree UNION ALL SELECT 1, NULL, level, i, n, h FROM crown
), steps AS (
  SELECT x.doc_id, x.lang, x.i, v.part, v.level, CASE WHEN s.h IS NULL THEN '' WHEN s.i % 2 = 0 THEN 'l' || s.h ELSE 'r' || s.h END AS step
  FROM leaves x JOIN subroots r ON x.lang IS NOT DISTINCT FROM r.lang
  JOIN (SELECT DISTINCT part, lang, level, n FROM nodes WHERE n > 1) v ON v.part = 1 OR v.lang IS NOT DISTINCT FROM x.lang
  LEFT JOIN nodes s ON s.part = v.part AND s.lang IS NOT DISTINCT FROM v.lang AND s.level = v.level AND s.i = xor((CASE v.part WHEN 0 THEN x.i ELSE r.i END) >> v.level, 1)
), paths AS (
  SELECT lang, i, list(step ORDER BY part, level) AS path FROM steps GROUP BY lang, i
), folded AS (
  SELECT x.doc_id, x.leaf, r.subroot, (SELECT h FROM crown WHERE n = 1) AS root, sha256(array_to_string([s[2:] FOR s IN coalesce(p.path, [])], '')) AS proof_sha256,
    list_reduce(list_concat([coalesce(x.claim, x.leaf)], p.path), lambda x, s: CASE WHEN s = '' THEN sha256(x) WHEN s[1] = 'l' THEN sha256(s[2:] || x) ELSE sha256(x || s[2:]) END) AS folded_root
  FROM leaves x JOIN subroots r ON x.lang IS NOT DISTINCT FROM r.lang LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM x.lang AND p.i = x.i
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


def query(spark, sf_dir: str) -> DataFrame:
    return verify_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tampered_leaf())
