"""Fuzzy line de-duplication: MinHash bands, exact Jaccard, distributed union-find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow_text import BASE, INVERSE, bounded_batches, chunks, distinct, mix, powers, utf8
from .components import components, discard, n_rows, release, settle, store
from .overlap import BLOCK_ITEMS, MOST_BESIDE, Block, forest, is_linked, open_tokens, sliced

BANDS, ROWS = 14, 6
SHINGLE = 5
SHORT, SHORT_SHINGLE, SHORT_BANDS = (24, 64), 3, 20
"""Least and greatest length of the lines that are compared by shorter windows too; and the bands for those."""
SHORT_ITEM = 2
"""A short line is two items: its key, by windows of SHINGLE, and its key with this bit, by SHORT_SHINGLE."""
CHUNK = 1 << 18
POSTINGS, PLACES = 1 << 18, 1 << 16
"""As many postings and places of lines a map task holds before it sends them on."""
STAR, PAIR, FIRST, GONE, POSTING, PLACE = range(6)
FEW_LINES = 1_000_000
"""Up to as many lines to take out (20 bytes each) go to the texts; of more, the texts are shuffled."""
FEW_PAIRS = 64
"""As many pairs of lines of a block are compared without an index."""
BATCH, LINKS = 256, 1 << 14
"""Lines that are compared with a block at once; and links that a task holds before it sends them on, as a batch for each block would cost more."""
SEGMENT, PROBES = 1 << 16, 4
"""Bits of a segment of the filter of places, and how many of them stand for a place."""
FILTER_BITS, FILTER_MOST = 12, 1 << 28
"""Bits of the filter for each place in it, and of the whole filter at most: of a fuller one more lines come along that nothing asks for."""
_VALUE = mix(np.arange(7, 7 + (1 << 16), dtype=np.uint64))
"""The value of each code point of the basic plane in a line's polynomial; others are worked out."""
_SCALE = mix(np.arange(31, 31 + 8, dtype=np.uint64)) | np.uint64(1)
_BLANK = np.zeros(1 << 14, bool)
_BLANK[[*range(33), 0xA0, 0x3000]] = True


def _values(codes: np.ndarray) -> np.ndarray:
    if not len(codes) or codes.max() < len(_VALUE):
        return _VALUE[codes]
    return mix(codes.astype(np.uint64) + np.uint64(7))


class Lines:
    """The lines of some texts as one array of code points with prefix sums."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        row_at = offs
        if len(codes) < len(data):
            # code point offsets of the rows: bytes that do not continue a character
            heads = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
            np.cumsum(data.view(np.int8) >= -64, out=heads[1:])
            row_at = heads[offs].astype(np.int64)
        breaks = np.flatnonzero(codes == 10)
        # every row has one line more than it has breaks
        n_rows = len(offs) - 1
        per_row = np.bincount(np.searchsorted(row_at, breaks, "right") - 1, minlength=n_rows) + 1
        self.row = np.repeat(np.arange(n_rows), per_row)
        first = np.concatenate(([0], np.cumsum(per_row)))
        starts, stops = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
        is_first, is_last = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
        is_first[first[:-1]], is_last[first[1:] - 1] = True, True
        starts[is_first], starts[~is_first] = row_at[:-1], breaks + 1
        stops[is_last], stops[~is_last] = row_at[1:], breaks
        self.starts, self.stops = starts, stops
        self.position = np.arange(first[-1]) - first[self.row]
        n = len(codes)
        self.inverse = powers(INVERSE, n + 1)
        self.values = _values(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values * powers(BASE, n + 1)[:n], out=self.sums[1:])
        self.blank = starts == stops
        # a line can be blank only if it begins so
        for i in np.flatnonzero(~self.blank & _BLANK[np.minimum(codes[np.minimum(starts, n - 1)], len(_BLANK) - 1)]).tolist() if n else ():
            self.blank[i] = _BLANK[np.minimum(codes[starts[i] : stops[i]], len(_BLANK) - 1)].all()
        key = mix((self.sums[stops] - self.sums[starts]) * self.inverse[starts] + (stops - starts).astype(np.uint64)) & ~np.uint64(SHORT_ITEM) | np.uint64(1)
        self.key = np.where(self.blank, np.uint64(0), key).view(np.int64)

    def shingles(self, which: np.ndarray, size: int | np.ndarray = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every window of `size` (one, or of each line) code points of the lines, and offsets; a shorter line is one window."""
        starts, lengths = self.starts[which], self.stops[which] - self.starts[which]
        counts = np.maximum(lengths - size + 1, 1)
        offs = np.concatenate(([0], np.cumsum(counts)))
        at = np.arange(offs[-1]) - np.repeat(offs[:-1] - starts, counts)
        width = np.repeat(np.minimum(lengths, size), counts)
        return mix((self.sums[at + width] - self.sums[at]) * self.inverse[at] + width.astype(np.uint64)), offs


    def short_windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """32-bit hashes of every window of SHORT_SHINGLE code points of the lines, and offsets."""
        hashes, offs = self.shingles(which, SHORT_SHINGLE)
        return (hashes >> np.uint64(32)).astype(np.uint32), offs

    def windows(self, which: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """32-bit hashes of every window of `size` code points of the lines, and offsets; for signatures, where a sum of scaled values will do."""
        lengths = self.stops[which] - self.starts[which]
        long = lengths >= size
        n = len(self.values) - size + 1
        rolled = np.zeros(max(n, 0), np.uint64)
        scaled = np.empty_like(rolled)
        for j in range(size if n > 0 else 0):
            rolled += np.multiply(self.values[j : j + n], _SCALE[j], out=scaled)
        counts = np.where(long, lengths - size + 1, 1)
        offs = np.concatenate(([0], np.cumsum(counts)))
        at = np.arange(offs[-1]) - np.repeat(offs[:-1] - self.starts[which], counts)
        out = (rolled[np.minimum(at, max(n - 1, 0))] >> np.uint64(32)).astype(np.uint32) if n > 0 else np.zeros(len(at), np.uint32)
        out[offs[:-1][~long]] = (self.key[which][~long].view(np.uint64) >> np.uint64(32)).astype(np.uint32)
        return out, offs


def _bands(short: np.ndarray, offs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys (lines x bands) of the MinHash signatures of 32-bit hashes."""
    multipliers = (mix(np.arange(101, 101 + bands * rows, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
    n = len(offs) - 1
    least, scaled = np.empty((bands * rows, n), np.uint32), np.empty_like(short)
    for i, m in enumerate(multipliers):
        np.minimum.reduceat(np.multiply(short, m, out=scaled), offs[:-1], out=least[i])
    keys = np.repeat(mix(np.arange(1, bands + 1, dtype=np.uint64) * BASE)[:, None], n, axis=1)
    scales = mix(np.arange(901, 901 + rows, dtype=np.uint64)) | np.uint64(1)
    for r in range(rows):
        keys += least[r::rows] * scales[r]
    return mix(keys).T


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)


def stars(postings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of postings (token, item): rows (token, item, centre) of the tokens that several items hold, whether these are a token's only two, and one posting of every token, its centre's.

    The centre is the least item. What a map task sends on of a token is one
    posting, so no token is too frequent for the task that gathers it, and the
    items of a token are joined with its centre by way of their own task's. An
    item's last bit is 1; in a posting that stands for several it is 0.
    """
    postings = postings[np.argsort(postings[:, 0])]
    starts = _runs(postings[:, 0])
    runs = np.diff(np.append(starts, len(postings)))
    crowd = postings[np.repeat(runs > 1, runs)]
    crowd = crowd[np.lexsort((crowd[:, 1] & 1, crowd[:, 1] | 1, crowd[:, 0]))]
    new = np.ones(len(crowd), bool)
    new[1:] = (crowd[1:, 0] != crowd[:-1, 0]) | (crowd[1:, 1] | 1 != crowd[:-1, 1] | 1)
    crowd = crowd[new]
    least = _runs(crowd[:, 0])
    sizes = np.diff(np.append(least, len(crowd)))
    full = np.minimum.reduceat(crowd[:, 1] & 1, least) == 1 if len(least) else np.empty(0, bool)
    rest = postings[starts]
    rest[runs > 1] = np.where((sizes > 1)[:, None], np.column_stack((crowd[least, 0], crowd[least, 1] & ~1)), crowd[least])
    crowd[:, 1] |= 1
    several = np.repeat(sizes > 1, sizes)
    found = np.column_stack((crowd, np.repeat(crowd[least, 1], sizes)))[several]
    return found, np.repeat((sizes == 2) & full, sizes)[several], rest


KNOWN, LENGTH = 62, 31
"""A place's last number holds the line's length below this bit, its number in the text above it, and from KNOWN on whether there is a doc_id."""


def firsts(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places (key, doc_id, hash of text, last number): the first of each key, and the others that differ from it."""
    places = places[np.lexsort((places[:, 3], places[:, 2], places[:, 1], places[:, 3] >> KNOWN, places[:, 0]))]
    starts = _runs(places[:, 0])
    first = places[starts]
    return first, places[(places != np.repeat(first, np.diff(np.append(starts, len(places))), axis=0)).any(axis=1)]


def _blobs(kind: int, rows: np.ndarray, spread: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The rows packed to one blob a bucket: a row for each would cost more than it holds. Buckets are ranges of `spread`."""
    bucket = ((spread.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    if (bucket[1:] < bucket[:-1]).any():
        order = np.argsort(bucket, kind="stable")
        bucket, rows = bucket[order], rows[order]
    starts = _runs(bucket)
    payload = [rows[a:b].tobytes() for a, b in zip(starts, np.append(starts[1:], len(bucket)))]
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(np.full(len(starts), kind, np.int8)), pa.array(payload, pa.binary())], names=["bucket", "kind", "payload"])


def _scan(bands: int, rows: int, buckets: int):
    """From (doc_id, th, text) blobs of the places of lines and of the postings of their bands, in one pass."""

    def run(batches):
        held, spots, n_held, n_spots, seen = [], [], 0, 0, set()

        def send_postings():
            found, _, rest = stars(np.concatenate(held))
            if len(found):
                yield _blobs(STAR, found, found[:, 1].copy(), buckets)
            yield _blobs(POSTING, rest, rest[:, 0].copy(), buckets)

        def send_places():
            first, others = firsts(np.concatenate(spots))
            yield _blobs(PLACE, first, first[:, 0].copy(), buckets)
            if len(others):
                yield _blobs(GONE, others, others[:, 2].copy(), buckets)

        for batch in batches:
            data, offs = utf8(batch.column(2))
            ids = batch.column(0)
            known = np.asarray(ids.is_valid()).astype(np.int64) << KNOWN
            ids, hashes = ids.fill_null(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi in chunks(offs, CHUNK):
                lines = Lines(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                row = lines.row + lo
                inked = lines.key != 0
                lengths = lines.stops - lines.starts
                last = np.minimum(lengths, (1 << LENGTH) - 1) | lines.position << LENGTH | known[row]
                spots.append(np.column_stack((lines.key, ids[row], hashes[row], last))[inked])
                n_spots += len(spots[-1])
                which = np.flatnonzero(np.array([k != 0 and not (k in seen or seen.add(k)) for k in lines.key.tolist()], bool))
                short = which[(lengths[which] >= SHORT[0]) & (lengths[which] <= SHORT[1])]
                for part, made, n, bit in ((which, lines.windows, bands, 0), (short, lines.short_windows, SHORT_BANDS, SHORT_ITEM)):
                    if len(part):
                        tokens = _bands(*made(part), n, rows).ravel().view(np.int64)
                        held.append(np.column_stack((tokens, np.repeat(lines.key[part] | bit, n))))
                        n_held += len(tokens)
                if n_held >= POSTINGS:
                    yield from send_postings()
                    held, n_held = [], 0
                if n_spots >= PLACES:
                    yield from send_places()
                    spots, n_spots = [], 0
        if n_held:
            yield from send_postings()
        if n_spots:
            yield from send_places()

    return run


FOUND = "kind byte, a long, b long, c long, pos int, length int"


def _gather(batches):
    """From blobs the rows (STAR, token, item, centre), (PAIR, token, item, centre) of tokens with these two items only, (FIRST, key, doc_id, th, line) and (GONE, key, doc_id, th, line)."""
    parts: dict[int, list] = {}
    for batch in batches:
        for kind, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            width = 4 if kind in (PLACE, GONE) else 3 if kind == STAR else 2
            parts.setdefault(kind, []).append(np.frombuffer(payload, np.int64).reshape(-1, width))

    def rows(kind: int, found: np.ndarray):
        for lo in range(0, len(found), 1 << 16):
            part = found[lo : lo + (1 << 16)]
            a, b, c = (pa.array(np.ascontiguousarray(part[:, i])) for i in range(3))
            pos = length = pa.nulls(len(part), pa.int32())
            if kind > PAIR:
                last = part[:, 3]
                b = pa.array(np.ascontiguousarray(part[:, 1]), mask=last >> KNOWN == 0)
                pos, length = (pa.array(x.astype(np.int32)) for x in (last >> LENGTH & ((1 << KNOWN - LENGTH) - 1), last & ((1 << LENGTH) - 1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int8)), a, b, c, pos, length], names=["kind", "a", "b", "c", "pos", "length"])

    for kind in (STAR, GONE):
        if kind in parts:
            yield from rows(kind, np.concatenate(parts.pop(kind)))  # blobs are small, and a batch for each would cost more than its rows
    if POSTING in parts:
        found, alone, _ = stars(np.concatenate(parts.pop(POSTING)))
        yield from rows(STAR, found[~alone])
        yield from rows(PAIR, found[alone & (found[:, 1] != found[:, 2])])
    if PLACE in parts:
        first, others = firsts(np.concatenate(parts.pop(PLACE)))
        yield from rows(FIRST, first)
        yield from rows(GONE, others)


def line_sets(texts, items: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys and sets of window hashes of some lines, the windows being of the size that the item asks for."""
    short = items & SHORT_ITEM
    keys, sets = [np.empty(0, np.int64)], []
    data, offs = utf8(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    for lo, hi in chunks(offs, CHUNK):
        lines = Lines(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        hashes, bounds = lines.shingles(np.arange(hi - lo), np.where(short[lo:hi] > 0, SHORT_SHINGLE, SHINGLE))
        found, bounds = distinct(np.repeat(np.arange(hi - lo), np.diff(bounds)), hashes, hi - lo)
        keys.append(lines.key | short[lo:hi])
        sets += [found[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    return np.concatenate(keys), sets


def _search(percent: int):
    """Over rows (block, slice, asks, item, body) in this order: links of the items that ask with the others of their block, by the exact Jaccard index.

    An item is the row of its number that comes first; a block's members are
    held, those that ask stream past them.
    """

    def run(batches):
        place, members, index, asking, pairs, found, before = None, [], None, [], [], [], None

        def ask():
            nonlocal index
            if len(asking) * len(members) <= FEW_PAIRS:
                pairs.extend((other, item) for other, own in asking for item, mine in members if item != other and is_linked(own, mine, percent))
            else:
                index = index or Block([m[1] for m in members])
                a, b = index.links([own for _, own in asking], percent)
                pairs.extend((asking[i][0], members[j][0]) for i, j in zip(a.tolist(), b.tolist()))
            asking.clear()

        for batch in batches:
            _, offs = utf8(batch.column(4))
            items = batch.column(3).to_numpy()
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), items.tolist())
            for lo, hi in chunks(offs, 2 * CHUNK):
                sets = line_sets(batch.column(4).slice(lo, hi - lo), items[lo:hi])[1]
                for own, row in zip(sets, rows):
                    if row == before:
                        continue
                    before = row
                    if row[:2] != place:
                        ask()
                        found += _tree(pairs)
                        if len(found) >= LINKS:
                            yield _links(found)
                            found = []
                        place, members, index, pairs = row[:2], [], None, []
                    if not row[2]:
                        members.append((row[3] & ~SHORT_ITEM, own))
                        continue
                    asking.append((row[3] & ~SHORT_ITEM, own))
                    if len(asking) == BATCH:
                        ask()
        ask()
        found += _tree(pairs)
        if found:
            yield _links(found)

    return run


def _tree(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of one block."""
    return forest([p for p in pairs if p[0] != p[1]]) if pairs else []


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])


def _line_of(item: str) -> F.Column:
    """Key of the line that an item stands for."""
    return F.col(item).bitwiseAND(F.lit(~SHORT_ITEM).cast("long"))


def _probes(doc: np.ndarray, pos: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Of places (hash of the document, number of the line) their segments of the filter, and their bits (places x PROBES) in these."""
    doc = np.ascontiguousarray(doc).view(np.uint64)
    hashed = mix(doc + (pos.astype(np.uint64) + np.uint64(1)) * BASE)
    bits = hashed[:, None] >> (np.uint64(16) * np.arange(PROBES, dtype=np.uint64)) & np.uint64(SEGMENT - 1)
    return ((doc >> np.uint64(32)) % np.uint64(segments)).astype(np.int64), bits.astype(np.int64)


def _fill(segments: int):
    """From (doc, pos) rows, all of a segment in one task, (segment, bits)."""

    def run(batches):
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            segment, bits = _probes(batch.column(0).to_numpy(), batch.column(1).to_numpy(), segments)
            for s in np.unique(segment).tolist():
                made.setdefault(s, np.zeros(SEGMENT, bool))[bits[segment == s].ravel()] = True
        for s, bits in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["segment", "bits"])

    return run


def _lines_at(filled, segments: int):
    """From (doc, text) rows (k, body) of the lines whose places the filter holds."""

    def run(batches):
        held = filled.value
        for batch in batches:
            doc = batch.column(0).to_numpy()
            data, offs = utf8(batch.column(1))
            breaks = np.flatnonzero(data == 10)
            before = np.searchsorted(breaks, offs)
            counts = np.diff(before) + 1
            row = np.repeat(np.arange(len(counts)), counts)
            first = np.cumsum(counts) - counts
            pos = np.arange(len(row)) - first[row]
            segment, bits = _probes(doc[row], pos, segments)
            which = np.arange(len(row))
            for j in range(PROBES):
                bit = bits[which, j]
                which = which[held[segment[which], bit >> 3] >> (7 - (bit & 7)) & 1 > 0]
            starts, stops = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
            inner = pos > 0
            starts[~inner], starts[inner] = offs[:-1], breaks + 1
            stops[first + counts - 1] = offs[1:]
            stops[np.flatnonzero(inner) - 1] = breaks
            raw = data.tobytes()
            for lo in range(0, len(which), 1 << 12):
                part = which[lo : lo + (1 << 12)]
                bodies = pa.array([raw[a:b] for a, b in zip(starts[part].tolist(), stops[part].tolist())], pa.binary()).cast(pa.string())
                codes, ends = utf8(bodies)
                keys = [Lines(codes[ends[a] : ends[b]], ends[a : b + 1] - ends[a]).key for a, b in chunks(ends, CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), bodies], names=["k", "body"])

    return run


def bodies_of(keyed: DataFrame, spots: DataFrame) -> DataFrame:
    """(k, body) of the lines whose first places are in spots; some others come too, and those of rows that repeat do as often.

    Texts are not shuffled: a filter of the places goes to them, of a few bytes
    a line and bounded in all, and only lines that it holds leave a task.
    """
    spark = keyed.sparkSession
    segments = max(1, min(FILTER_MOST, n_rows(spots) * FILTER_BITS) // SEGMENT)
    places = spots.select(F.xxhash64("d", "th").alias("doc"), "pos")
    tasks = min(segments, int(spark.conf.get("spark.sql.shuffle.partitions")))
    segment = F.pmod(F.shiftrightunsigned("doc", 32), F.lit(segments))
    parts = places.repartition(tasks, segment).mapInArrow(_fill(segments), "segment int, bits binary").collect()
    held = np.zeros((segments, SEGMENT // 8), np.uint8)
    for part in parts:
        held[part.segment] = np.frombuffer(part.bits, np.uint8)
    filled = spark.sparkContext.broadcast(held)
    return keyed.select(F.xxhash64("doc_id", "th").alias("doc"), "text").mapInArrow(_lines_at(filled, segments), "k long, body string")


def band_visits(still: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, block): the blocks that members of other components than a band's largest visit, and the members of all blocks.

    still: (token, k, root, top), a row once. The least of an item's tokens is
    its own, and the least that items of a token have leads it; tokens of one
    leader share their items, which have blocks of their own, one for
    BLOCK_ITEMS of them. So bands of similar lines are mostly searched
    together, a band is never apart, and where its leader has up to as many
    items, each sends its text twice for it at most.
    """
    own = still.groupBy("k").agg(F.min("token").alias("own"))
    lead = still.join(own, "k").groupBy("token").agg(F.min("own").alias("lead"))
    led = settle(still.join(lead, "token").groupBy("lead", "k").agg(F.max(F.col("root") != F.col("top")).alias("asks")))
    crowds = led.groupBy("lead").agg((F.count("*") / BLOCK_ITEMS).cast("int").alias("last"))
    led = led.join(crowds, "lead")
    block = F.xxhash64("lead", "part").alias("block")
    visits = led.where("asks").select("lead", "k", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("part")).select("k", block)
    return visits, led.withColumn("part", F.pmod(F.xxhash64("k"), F.col("last") + 1).cast("int")).select("k", block)


def line_links(found: DataFrame, bodies: DataFrame, spots: DataFrame, pairs: DataFrame, few: bool, percent: int) -> DataFrame:
    """(node, root) of the lines that link with another.

    found holds the STAR rows of `_gather`, pairs their (item, centre), spots
    the first place of each line in them, bodies their texts; few: whether
    there are MOST_BESIDE of the lines at most. A line's text goes once to each
    block in which it is compared.
    """
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def links_of(visits: DataFrame, index: DataFrame, few: bool = False) -> DataFrame:
        """Links (a, b) of lines of each visit (k, block) with the members (k, block) of the block."""
        sizes = visits.select("k").distinct().withColumn("line", _line_of("k")).join(spots.withColumnRenamed("k", "line"), "line").select("k", F.col("length").alias("bytes"))
        visits, index = sliced(visits, index, sizes, few)
        roles = settle(visits.withColumn("asks", F.lit(1)).union(index.withColumn("asks", F.lit(0))))
        release(found.sparkSession)
        asked = roles.select(F.col("k").alias("item"), _line_of("k").alias("k"), F.col("block").cast("long").alias("block"), "slice", "asks")
        rows = bodies.join(F.broadcast(asked) if few or n_rows(roles) <= MOST_BESIDE else asked, "k").select("block", "slice", "asks", "item", "body")
        return rows.repartition(n, "block", "slice").sortWithinPartitions("block", "slice", "asks", "item").mapInArrow(_search(percent), "a long, b long")

    star = found.where(F.col("kind") == STAR).select(F.col("a").alias("token"), F.col("b").alias("item"), F.col("c").alias("centre"))
    centres = pairs.select(F.col("centre").alias("k"), F.col("centre").alias("block")).distinct()
    # a centre's block has one member, and so not more rows than it has visits
    links = settle(links_of(pairs.select(F.col("item").alias("k"), F.col("centre").alias("block")), centres, few))
    release(found.sparkSession)
    few_tasks = max(1, n // 4)  # links are few rows of each search's task
    roots = components(links.coalesce(few_tasks))
    # two items that are a token's only ones are compared; of more, those that the star has not joined still are to be
    several = star.groupBy("token").agg(F.count("*").alias("c")).where("c > 2").select("token")
    placed = star.join(several, "token").select("token", F.col("item").alias("k"), _line_of("item").alias("node")).distinct()
    placed = placed.join(roots, "node", "left").select("token", "k", F.coalesce("root", "node").alias("root"))
    still = settle(open_tokens(settle(placed)))
    if still.isEmpty():
        return roots
    more = settle(links_of(*band_visits(still)))
    release(found.sparkSession)
    return components(links.union(more).coalesce(few_tasks))


def dedup_lines(docs: DataFrame, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs with two more columns: line_keep (array<boolean>, null: all lines stay) and kept_text.

    Lines are the parts of a text between line feeds. Two lines link when the
    Jaccard index of their distinct windows of 5 code points is at least
    percent / 100, or, where both have 24 to 64 code points, that of their
    windows of 3. So a changed character in mid-line does not hide a copy of 29
    code points or more. Candidates share one of `bands` MinHash bands of `rows`
    values (a pair at 0.8 is found with probability 0.986, at 0.9 0.9999), or
    one of 20 by windows of 3 (0.998), and
    every candidate is verified exactly. Of each component of linked lines the
    first by (doc_id, hash of the text, place) stays, all others go.

    Blank lines always stay. A null text is kept as null, an empty text as
    empty. Rows equal in doc_id and text keep the same lines; a null doc_id
    comes before all others. Other columns pass through, whatever their names
    (a column called line_keep or kept_text is replaced). An empty table gives
    an empty table.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop("line_keep", "kept_text")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").where("text <> ''")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blobs = keyed.mapInArrow(_scan(bands, rows, 8 * n), "bucket int, kind byte, payload binary")
    found, found_at = store(blobs.repartition(n, "bucket").mapInArrow(_gather, FOUND), "kind")
    release(spark)
    pairs = settle(found.where(F.col("kind").isin(STAR, PAIR) & (F.col("b") != F.col("c"))).select(F.col("b").alias("item"), F.col("c").alias("centre")).distinct())
    release(spark)
    lines = pairs.select(F.explode(F.array(_line_of("item"), _line_of("centre"))).alias("k")).distinct()
    first = found.where(F.col("kind") == FIRST).select(F.col("a").alias("k"), F.col("b").alias("d"), F.col("c").alias("th"), "pos", "length")
    few = n_rows(pairs) <= MOST_BESIDE // 2  # a pair has two lines at most
    spots = settle(first.join(F.broadcast(lines) if few else lines, "k"))
    release(spark)  # again, as files of the first scan are large and one call can come too early
    bodies, bodies_at = store(bodies_of(keyed, spots))
    roots = line_links(found, bodies, spots, pairs, few, percent)
    discard(spark, bodies_at)
    release(spark)
    place = F.struct("d", "th", "pos")
    linked = spots.join(roots.withColumnRenamed("node", "k"), "k").select("root", place.alias("place"))
    # the first places of linked lines go but for the first of each component, which is taken out of them again
    stay = linked.groupBy("root").agg(F.min("place").alias("place"))
    others = found.where(F.col("kind") == GONE).select(F.struct(F.col("b").alias("d"), F.col("c").alias("th"), "pos").alias("place"))
    moves = others.union(linked.select("place")).select("place.*", F.lit(False).alias("stays")).union(stay.select("place.*", F.lit(True).alias("stays")))
    lists = moves.groupBy("d", "th").agg(F.collect_set(F.when(~F.col("stays"), F.col("pos"))).alias("out"), F.collect_set(F.when(F.col("stays"), F.col("pos"))).alias("in"))
    gone = settle(lists.select("d", "th", F.array_except("out", "in").alias("gone")).where("size(gone) > 0"))
    discard(spark, found_at)
    release(spark)
    few = (gone.agg(F.sum(F.size("gone"))).first()[0] or 0) <= FEW_LINES

    own = docs.columns
    new = lambda name: name + "_" * max(map(len, own))  # no column of docs has such a name
    d, th, out = (new(c) for c in ("d", "th", "gone"))
    gone = gone.select(F.col("d").alias(d), F.col("th").alias(th), F.col("gone").alias(out))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(th))
    marked = docs.join(F.broadcast(gone) if few else gone.hint("shuffle_hash"), same, "left")  # texts need no sort
    # a text is split once, and only where lines go
    parts = new("parts")
    marked = marked.select(*[F.col(f"`{c}`") for c in own], out, F.when(F.col(out).isNotNull(), F.split("text", "\n", -1)).alias(parts))
    flags = F.when(F.col(out).isNotNull(), _flags(F.col(out), F.size(parts)))
    marked = marked.select(*[F.col(f"`{c}`") for c in own], parts, flags.alias("line_keep"))
    kept = F.array_join(F.filter(parts, lambda x, i: F.get("line_keep", i)), "\n")
    return marked.withColumn("kept_text", F.when(F.col("line_keep").isNull(), F.col("text")).otherwise(kept)).drop(parts)


def _flags(gone, n):
    """n flags, false at the distinct places `gone`, in time linear in n; null where `gone` is."""
    at = F.array_sort(gone)
    runs = F.zip_with(F.concat(at, F.array(n)), F.concat(F.array(F.lit(-1)), at), lambda stop, before: stop - before - 1)
    flags = F.flatten(F.transform(runs, lambda run: F.array_append(F.array_repeat(F.lit(True), run), F.lit(False))))
    return F.slice(flags, 1, n)


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    n_lines = F.when(F.col("line_keep").isNotNull(), F.size("line_keep")).when(F.col("text") != "", breaks + 1).otherwise(0)
    n_gone = F.coalesce(F.size(F.filter("line_keep", lambda x: ~x)), F.lit(0))
    return out.select("doc_id", n_lines.cast("long").alias("n_lines"), (n_lines - n_gone).cast("long").alias("n_kept"), F.col("kept_text").alias("text"))
