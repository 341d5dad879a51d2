"""T-occurrence search over blocks of an inverted index, with DivideSkip.

Items are keyed sets. A token table names which items may link (they share a
token of their prefixes, or a band). Items are dealt to blocks; each block is
an inverted index that the items which may link to one of its members visit.
Links are searched in two rounds: first each item visits the block of one
centre a token, and what links is joined to components; then only members of
other components than a token's largest visit all its blocks. So a large
group of near copies is not searched all against all. Where a block has very
many visitors, they are searched in slices, each beside a copy of the block.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .components import components, n_rows, release, settle

BLOCK_ITEMS = 500
SLICE_ITEMS, SLICE_BYTES = 4000, 1 << 23
"""About as many visits of a block, and bytes of their texts, are searched in one task; a block with more is copied to several."""
ENTRIES = 1 << 19
"""As many entries of lists are counted at once."""
PROBE = 1.0
"""What a step of a binary search costs, in entries of a merge: DivideSkip's mu."""
SKIPPED = 0.75
"""The share of the lists a link can do without that are left out of the count; of few lists more items come out that do not link."""
BLOCK_TOKENS = 1 << 21
"""About as many tokens has a block at most, but for one set that has more."""


def needed(n: int, m: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of sets of n and m with 100 * overlap >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


class Block:
    """Inverted lists over the sets of some items, each list in item order."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        items = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.items = tokens[order], items[order]
        starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.empty(0, np.int64)
        self.tokens = tokens[starts]
        self.bounds = np.append(starts, len(tokens))
        self.probed = 0

    @cached_property
    def places(self) -> np.ndarray:
        """(list, item) of all entries, as one number each, ascending."""
        return np.repeat(np.arange(len(self.tokens)), np.diff(self.bounds)) * max(1, len(self.sizes)) + self.items

    def n_long(self, least: int, lengths: np.ndarray) -> int:
        """DivideSkip's number of lists to probe: T / (mu * log2(longest) + 1), fewer than the needed overlap."""
        return min(least - 1, len(lengths) - 1, int(least / (PROBE * math.log2(max(2, int(lengths[-1]))) + 1)))

    def search(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Items whose set links with the query set (sorted, distinct)."""
        n = len(query)
        at = np.searchsorted(self.tokens, query)
        inside = at < len(self.tokens)
        hit = at[inside][self.tokens[at[inside]] == query[inside]]
        least = max(1, -(-percent * n // 100))
        if len(hit) < least:
            return np.empty(0, np.int64)
        lengths = self.bounds[hit + 1] - self.bounds[hit]
        order = np.argsort(lengths, kind="stable")
        hit, lengths = hit[order], lengths[order]
        n_long = self.n_long(least, lengths)
        cut = len(hit) - n_long
        short, long = hit[:cut], hit[cut:]
        # merge the short lists: one gather of all their entries, counted by item
        total = np.cumsum(lengths[:cut])
        at = np.arange(total[-1]) + np.repeat(self.bounds[short] - np.concatenate(([0], total[:-1])), lengths[:cut])
        merged = np.bincount(self.items[at], minlength=len(self.sizes))
        found = np.flatnonzero(merged >= max(1, least - n_long))
        counts = merged[found]
        want = needed(n, self.sizes[found], percent)
        able = counts + n_long >= want
        found, counts, want = found[able], counts[able], want[able]
        if not len(found) or not n_long:
            return found[counts >= want]
        # probe the long lists for what is left of the candidates, by binary search among (list, item)
        asked = (long[:, None] * len(self.sizes) + found[None, :]).ravel()
        probe = np.minimum(np.searchsorted(self.places, asked), len(self.places) - 1)
        self.probed += len(asked)
        counts = counts + (self.places[probe] == asked).reshape(n_long, -1).sum(axis=0)
        return found[counts >= want]


    def links(self, queries: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, item) of all links of several queries, which suits sets of a few hundred.

        Of a query's lists the SKIPPED longest of those that a link can do
        without are left out, the others are merged in one count; what can
        still link is compared whole.
        """
        sizes = np.array([len(q) for q in queries], np.int64)
        tokens, owner = np.concatenate(queries), np.repeat(np.arange(len(queries)), sizes)
        at = np.searchsorted(self.tokens, tokens)
        at[at == len(self.tokens)] = 0
        hit = self.tokens[at] == tokens
        at, owner = at[hit], owner[hit]
        lengths = self.bounds[at + 1] - self.bounds[at]
        least = np.maximum(1, -(-percent * sizes // 100))
        hits = np.bincount(owner, minlength=len(queries))
        skipped = np.where(hits < least, hits, ((least - 1) * SKIPPED).astype(np.int64))
        order = np.argsort(owner << 32 | lengths)
        owner = owner[order]
        kept = np.arange(len(owner)) - (np.cumsum(hits) - hits)[owner] < (hits - skipped)[owner]
        at, owner, lengths = at[order[kept]], owner[kept], lengths[order[kept]]
        n = len(self.sizes)
        counts = np.zeros(len(queries) * n, np.int64)
        # parts of a bounded number of entries, whatever the lists' lengths
        part = np.cumsum(lengths) // ENTRIES
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))).tolist() if len(part) else []
        for lo, hi in zip(starts, [*starts[1:], len(part)]):
            some = lengths[lo:hi]
            ends = np.cumsum(some)
            entries = np.arange(ends[-1]) + np.repeat(self.bounds[at[lo:hi]] - (ends - some), some)
            counts += np.bincount(self.items[entries] + np.repeat(owner[lo:hi] * n, some), minlength=len(counts))
        a, b = np.nonzero(counts.reshape(-1, n))
        able = counts[a * n + b] + skipped[a] >= needed(sizes[a], self.sizes[b], percent)
        able &= 100 * np.minimum(sizes[a], self.sizes[b]) >= percent * np.maximum(sizes[a], self.sizes[b])
        a, b = a[able], b[able]
        linked = np.array([is_linked(queries[i], self.sets[j], percent) for i, j in zip(a.tolist(), b.tolist())], bool)
        return a[linked], b[linked]


def is_linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * overlap >= percent * union for two sets of distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    shared = np.count_nonzero(both[1:] == both[:-1])
    return 100 * shared >= percent * (len(both) - shared)


def forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that join two trees, in order: a spanning forest of all of them."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _search_block(to_sets: Callable, percent: int) -> Callable:
    def sets_of(keys: pd.Series, texts: pd.Series) -> tuple[list[int], list[np.ndarray]]:
        """Of each text that is the one its key was made of; rows of one doc_id can differ in text."""
        keys = keys.to_numpy(np.int64)
        made, sets = to_sets(texts.to_list(), keys)
        right = np.flatnonzero(made == keys)
        return keys[right].tolist(), [sets[i] for i in right]

    def run(key, members: pd.DataFrame, visits: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(visits):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        keys, sets = sets_of(members["k"], members["body"])
        block, keys = Block(sets), np.array(keys, np.int64)
        pairs = []
        for k, asked in zip(*sets_of(visits["asker"], visits["asked"])):
            found = keys[block.search(asked, percent)]
            pairs += [(k, other) for other in found.tolist() if other != k]
        kept = forest(pairs)
        return pd.DataFrame(kept, columns=["a", "b"]).astype("int64")

    return run


MOST_BESIDE = 1_000_000
"""As many rows of a few bytes are broadcast at most."""


def is_few(df: DataFrame, limit: int = MOST_BESIDE) -> bool:
    """Whether a table of a few bytes a row is small enough to broadcast."""
    return df.limit(limit + 1).count() <= limit


def sliced(visits: DataFrame, members: DataFrame, sizes: DataFrame, few: bool = False) -> tuple[DataFrame, DataFrame]:
    """(k, block, slice) of the visits, each in one slice of its block, and of the members, each in all slices of its block.

    sizes: (k, bytes), no k twice. A slice has about SLICE_ITEMS visits or
    SLICE_BYTES of text at most, whatever the number of a block's visitors.
    few: whether the visits are known to be few enough to broadcast.
    """
    parts = F.greatest(F.count("*") / SLICE_ITEMS, F.sum("bytes") / SLICE_BYTES).cast("int") + 1
    slices = settle(visits.join(sizes, "k").groupBy("block").agg(parts.alias("slices")))
    slices = F.broadcast(slices) if few or n_rows(slices) <= MOST_BESIDE else slices
    own = F.pmod(F.xxhash64("k", F.lit("slice")), F.col("slices")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    return visits.join(slices, "block").select("k", "block", own.alias("slice")), members.join(slices, "block").select("k", "block", every.alias("slice"))


def _beside(df: DataFrame) -> DataFrame:
    """A table of a few bytes a row, sent to the other side of its join where it is small."""
    return F.broadcast(df) if is_few(df) else df


def _searched(visits: DataFrame, members: DataFrame, sets: DataFrame, to_sets: Callable, percent: int) -> DataFrame:
    """Links (a, b) of each visit (k, block) with the members of the block."""
    sizes = sets.groupBy("k").agg(F.sum(F.octet_length("body")).alias("bytes"))
    visits, members = sliced(visits, members, sizes)
    # (k, block, slice) rows are small beside texts, so where they are few they go to the texts
    index = sets.join(_beside(members), "k").select("block", "slice", "k", "body")
    asked = sets.join(_beside(visits), "k").select(F.col("block").alias("visited"), F.col("slice").alias("part"), F.col("k").alias("asker"), F.col("body").alias("asked"))
    return (
        index.groupBy("block", "slice").cogroup(asked.groupBy("visited", "part"))
        .applyInPandas(_search_block(to_sets, percent), "a long, b long")
    )


def size_class(n: F.Column, percent: int) -> F.Column:
    """Sets that link are of one class or of two that follow each other, as neither has more than 100 / percent times the other's size."""
    return F.floor(F.log(n.cast("double")) / math.log(100.1 / percent)).cast("int")


def deal_blocks(shared: DataFrame) -> DataFrame:
    """(k, block): items of one class with one least token share a block, so those that may link are mostly
    together; a token that is the least of many items, or of large ones, has several blocks. shared: (token, k,
    class), and n, the sizes of sets, if they differ much."""
    size = F.max("n") if "n" in shared.columns else F.lit(0)
    least = shared.groupBy("k").agg(F.min("token").alias("least"), F.first("class").alias("class"), size.cast("long").alias("n"))
    parts = lambda: F.greatest(F.count("*") / BLOCK_ITEMS, F.sum("n") / BLOCK_TOKENS)
    crowds = least.groupBy("least", "class").agg((parts() + 1).cast("int").alias("parts"))
    least = settle(least.join(crowds, ["least", "class"]))
    n_blocks = int(least.agg(parts()).first()[0] or 0) + 1
    block = F.pmod(F.xxhash64("least", "class", F.pmod(F.xxhash64("k"), F.col("parts"))), F.lit(n_blocks)).cast("int")
    return least.select("k", block.alias("block"))


def open_tokens(placed: DataFrame) -> DataFrame:
    """Rows (token, k, root, ...) of the tokens whose items are in several components, with the component `top` of most of them."""
    counts = placed.groupBy("token", "root").agg(F.count("*").alias("c"))
    top = counts.groupBy("token").agg(F.max_by("root", F.struct("c", "root")).alias("top"), F.count("*").alias("roots"))
    return placed.join(top.where("roots > 1").select("token", "top"), "token")


def open_visits(still: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, block): the blocks that members of other components than a token's largest visit, and the members of all blocks.

    still: (token, k, need, class, root, top, block), a row once.
    """
    near = F.explode(F.array(*[F.col("class") + i for i in (-1, 0, 1)]))
    askers = still.where("root <> top").select("token", "k", "need", near.alias("class"))
    blocks = still.select("token", "class", "block").distinct()
    # Of `need` shared tokens an item or its partner asks for half at least, so a
    # block with which fewer are shared holds no partner that this item must find.
    asked = askers.join(blocks, ["token", "class"]).select("token", "k", "block", "need").distinct()
    asked = asked.groupBy("k", "block").agg(F.count("*").alias("c"), F.max("need").alias("need"))
    visits = settle(asked.where("2 * c >= need").select("k", "block"))
    visited = visits.select("block").distinct()
    return visits, settle(still.select("k", "block").distinct().join(visited, "block"))


def link_components(shared: DataFrame, texts_of: Callable[[DataFrame], DataFrame], to_sets: Callable, percent: int) -> DataFrame:
    """(node, root) of items that link with another.

    shared: (token, k, need, n), n being the size of the set; items cannot link
    unless they share `need` tokens, for the need of either. No row comes twice.
    texts_of: given (k), the items asked for, returns their (k, body), body
    being the text that the set is made of; it moves less than the set would.
    to_sets: from a list of texts, and the keys they should have, their keys and
    their sets of sorted distinct 64-bit hashes. An item may come more than
    once, or with a wrong text.
    """
    shared = shared.select("token", "k", "need", "n", size_class(F.col("n"), percent).alias("class"))
    several = shared.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    shared = settle(shared.join(several, "token"))
    items = deal_blocks(shared)
    sets = settle(texts_of(items.select("k")))
    shared = settle(shared.drop("n").join(items, "k"))
    spark = shared.sparkSession
    release(spark)
    centres = shared.groupBy("token", "class").agg(F.min("k").alias("centre"), F.min_by("block", "k").alias("at"))
    stars = shared.join(centres, ["token", "class"]).where("k <> centre")
    first_visits = stars.select("k", F.col("at").alias("block")).distinct()
    first_index = stars.select(F.col("centre").alias("k"), F.col("at").alias("block")).distinct()
    first_visits, first_index = settle(first_visits), settle(first_index)
    links = settle(_searched(first_visits, first_index, sets, to_sets, percent))
    release(spark)
    roots = components(links)

    placed = shared.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    still = settle(open_tokens(placed))
    if still.isEmpty():
        return roots
    visits, index = open_visits(still)
    release(spark)
    more = settle(_searched(visits, index, sets, to_sets, percent))
    release(spark)
    return components(links.union(more))
