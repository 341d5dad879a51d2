"""Byte-level BPE where a segment tree over adjacent pair ranks picks each merge."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_text import bounded_batches, chunks, utf8

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
# The same split for texts of code points under U+0250, where letters and numbers are few ranges.
LOW_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
LOW_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
LOW_SPACES = "\t-\r \x85\xa0"
LOW_PATTERN = f"'(?:[stmd]|re|ve|ll)| ?[{LOW_LETTERS}]+| ?[{LOW_NUMBERS}]+| ?[^{LOW_SPACES}{LOW_LETTERS}{LOW_NUMBERS}]+|[{LOW_SPACES}]+(?![^{LOW_SPACES}])|[{LOW_SPACES}]+"
NONE = np.iinfo(np.int64).max
WIDE = 64
CACHE = 100_000


def read_tables(path: str) -> dict:
    """The vocabulary as bytes by id, the merges as sorted pair keys, and the special tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocab = spec["model"]["vocab"]
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = max([*vocab.values(), *specials.values()]) + 1
    names = [b""] * size
    for token, i in vocab.items():
        names[i] = bytes(byte_of[c] for c in token)
    for token, i in specials.items():
        names[i] = token.encode()
    first = np.zeros(256, np.int64)
    for c, b in byte_of.items():
        first[b] = vocab[c]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], np.int64)
    order = np.argsort(keys)
    return {"names": names, "first": first, "keys": keys[order], "ranks": order.astype(np.int64), "made": made, "specials": specials}


class BPE:
    """Encoder and decoder over `read_tables`."""

    def __init__(self, tables: dict):
        import regex

        self.names = np.array([*tables["names"], None], object)[:-1]
        self.first, self.keys, self.ranks, self.made = (tables[k] for k in ("first", "keys", "ranks", "made"))
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        self.specials = {t: np.array([i], "<u4").tobytes() for t, i in tables["specials"].items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")").split if self.specials else lambda t: [t]
        self.any_pieces, self.low_pieces = regex.compile(PATTERN).findall, re.compile(LOW_PATTERN).findall
        self.is_high = re.compile("[^\x00-\u024f]").search
        bits = (2 * len(self.keys)).bit_length() + 1
        self.shift, self.slots = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64)
        todo = np.arange(len(self.keys))
        slot = self._slot(self.keys)
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]
            lost = self.slots[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & (len(self.slots) - 1)
        self.cache: dict[str, bytes] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pieces(self, text: str) -> list[str]:
        return self.any_pieces(text) if self.is_high(text) else self.low_pieces(text)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair; NONE where it does not merge. An id under 0 is no symbol."""
        key = np.where((left >= 0) & (right >= 0), (left << 20) | right, -1).ravel()
        slot = self._slot(key)
        at = self.slots[slot]
        same = self.keys[at] == key
        out = np.where(same & (at >= 0), self.ranks[at], NONE)
        open_ = np.flatnonzero(~same & (at >= 0) & (key >= 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & (len(self.slots) - 1)
            at = self.slots[slot]
            same = (self.keys[at] == key[open_]) & (at >= 0)
            out[open_[same]] = self.ranks[at[same]]
            more = ~same & (at >= 0)
            open_, slot = open_[more], slot[more]
        return out.reshape(left.shape)

    def _forest(self, words: list[bytes], leaves: int) -> list[bytes]:
        """Encodes words of 2 to `leaves` bytes together: one segment tree a row.

        Leaf j holds rank * leaves + j of the pair that begins at symbol j, so
        a root is the leftmost pair of lowest rank. A merge changes at most
        three leaves and their ancestors.
        """
        n, lengths = len(words), np.array([len(w) for w in words])
        ids = np.full((n, leaves + 1), -1, np.int64)
        filled = np.arange(leaves + 1) < lengths[:, None]
        ids[filled] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(np.arange(1, leaves + 2), (n, 1))
        before = np.tile(np.arange(-1, leaves), (n, 1))
        tree = np.full((n, 2 * leaves), NONE, np.int64)
        rank = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        tree[:, leaves:] = np.where(rank < NONE, rank * leaves + np.arange(leaves), NONE)
        width = leaves // 2
        while width:
            tree[:, width : 2 * width] = np.minimum(tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2])
            width //= 2
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            at, made = root % leaves, self.made[root // leaves]
            gone = after[live, at]
            beyond = after[live, gone]
            ids[live, at] = made
            ids[live, gone] = -1
            after[live, at] = beyond
            inside = beyond <= leaves
            before[live[inside], beyond[inside]] = at[inside]
            prior = before[live, at]
            has = prior >= 0
            right_id = np.where(inside, ids[live, np.minimum(beyond, leaves)], -1)
            ahead = self.pair_ranks(made, right_id)
            behind = self.pair_ranks(np.where(has, ids[live, prior], -1), made)
            tree[live, leaves + at] = np.where(ahead < NONE, ahead * leaves + at, NONE)
            ok = gone < leaves
            tree[live[ok], leaves + gone[ok]] = NONE
            tree[live[has], leaves + prior[has]] = np.where(behind[has] < NONE, behind[has] * leaves + prior[has], NONE)
            rows = np.concatenate((live, live[ok], live[has]))
            node = np.concatenate((at, gone[ok], prior[has])) + leaves
            while leaves > 1 and node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            live = live[tree[live, 1] < NONE]
        left = ids >= 0
        flat = ids[left].astype("<u4").tobytes()
        ends = np.cumsum(left.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _long(self, word: bytes) -> bytes:
        """The same tree for one long word, in Python lists."""
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        leaves = 1 << (n - 1).bit_length()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [NONE] * (2 * leaves)
        rank_of, made = self.rank_of, self.made

        def key(a: int, b: int) -> int:
            r = rank_of.get((ids[a] << 20) | ids[b])
            return NONE if r is None else r * leaves + a

        for j in range(n - 1):
            tree[leaves + j] = key(j, j + 1)
        for j in range(leaves - 1, 0, -1):
            tree[j] = min(tree[2 * j], tree[2 * j + 1])

        def put(j: int, value: int) -> None:
            j += leaves
            tree[j] = value
            while j > 1:
                j >>= 1
                low = tree[2 * j] if tree[2 * j] < tree[2 * j + 1] else tree[2 * j + 1]
                if tree[j] == low:
                    break
                tree[j] = low

        while (root := tree[1]) < NONE:
            rank, at = divmod(root, leaves)
            gone = after[at]
            beyond = after[gone]
            ids[at], ids[gone] = int(made[rank]), -1
            after[at] = beyond
            put(gone, NONE)
            if beyond < n:
                before[beyond] = at
            put(at, key(at, beyond) if beyond < n else NONE)
            if before[at] >= 0:
                put(before[at], key(before[at], at))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Puts the codes of new words into the cache."""
        by_width: dict[int, list[str]] = {}
        raw = {w: w.encode() for w in words}
        for w, b in raw.items():
            if len(b) == 1:
                self.cache[w] = self.first[b[0]].astype("<u4").tobytes()
            elif len(b) > WIDE:
                self.cache[w] = self._long(b)
            else:
                by_width.setdefault(max(4, 1 << (len(b) - 1).bit_length()), []).append(w)
        for leaves, group in by_width.items():
            for lo in range(0, len(group), 1 << 12):
                part = group[lo : lo + (1 << 12)]
                self.cache.update(zip(part, self._forest([raw[w] for w in part], leaves)))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [[p if p in self.specials else self.pieces(p) for p in self.split(t)] for t in texts]
        words = set().union(*(p for t in cut for p in t if isinstance(p, list)))
        new = words - self.cache.keys()
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = words
        self.learn(new)
        code = self.cache.__getitem__
        return [b"".join(self.specials[p] if isinstance(p, str) else b"".join(map(code, p)) for p in t) for t in cut]

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(self.names[np.frombuffer(ids, "<u4")].tolist()).decode("utf-8", "replace")


def _run(tables, with_ids: bool):
    def run(batches):
        bpe = BPE(tables.value)
        for batch in batches:
            _, offs = utf8(batch.column(1))
            for lo, hi in chunks(offs):
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                codes = bpe.encode_batch(texts)
                columns = [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array([len(c) // 4 for c in codes], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in codes]),
                    pa.array([hashlib.sha256(bpe.decode(c).encode()).hexdigest() for c in codes]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    bounds = np.cumsum([0, *(len(c) // 4 for c in codes)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(codes), "<u4").astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_documents(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """One row a document: (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>]).

    path names a byte-level BPE file of the tokenizers library; the driver
    reads it and broadcasts its tables, whose size is the vocabulary's. Texts
    are encoded whole, without added special tokens; a special token's string
    in a text becomes that token, as the library does by default. The digests
    are of the ids as little-endian unsigned 32-bit integers and of the text
    decoded from them.

    A null text counts as empty and has no ids. Repeated rows give repeated
    rows; a null doc_id stays null. Other columns are ignored. An empty table
    gives an empty table.
    """
    bounded_batches(docs.sparkSession)
    tables = docs.sparkSession.sparkContext.broadcast(read_tables(path))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_run(tables, with_ids), schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path(), with_ids=False)
