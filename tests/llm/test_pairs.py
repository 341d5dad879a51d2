"""Near-duplicate operators against brute force, with nulls, ties, repeats and clashing columns."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import components, line_dedup, ngram_join, overlap, postings

WORD = re.compile(r"[^ \t-\r]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Union(dict):
    def top(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self[max(a, b)] = min(a, b)


def brute(sets, percent=80):
    union = Union()
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a != b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                union.join(a, b)
    return union


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 40, 200]))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    return [*texts, "", None, " \t ", "one", "One"]


def test_ngram_join_is_exact(spark, monkeypatch):
    monkeypatch.setattr(overlap, "BLOCK_ITEMS", 7)
    for seed in (1, 2):
        rows = [(i, t, i % 3, "x") for i, t in enumerate(corpus(seed))]
        sets = {i: shingles(t) for i, t, *_ in rows}
        union = brute(sets)
        got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, k int, token string")).collect()
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), union.top(i)) for i, s in sets.items()}


def test_visitors_of_one_block_are_sliced(spark, monkeypatch):
    visits = spark.createDataFrame([(k, 1) for k in range(900)] + [(k, 2) for k in range(9)], "k long, block int")
    members = spark.createDataFrame([(5000 + k, 1 + k % 2) for k in range(8)], "k long, block int")
    sizes = spark.createDataFrame([(k, 10) for k in range(900)], "k long, bytes long")
    for items, size in ((50, 1 << 20), (1 << 20, 500)):
        monkeypatch.setattr(overlap, "SLICE_ITEMS", items)
        monkeypatch.setattr(overlap, "SLICE_BYTES", size)
        asked, index = ([tuple(r) for r in df.collect()] for df in overlap.sliced(visits, members, sizes))
        counts = collections.Counter((b, s) for _, b, s in asked)
        assert sorted((k, b) for k, b, _ in asked) == sorted(map(tuple, visits.collect())) and max(counts.values()) <= 100
        places = collections.defaultdict(set)
        for k, b, s in index:
            places[k].add((b, s))
        assert all(places[5000 + k] >= {p for p in counts if p[0] == 1 + k % 2} for k in range(8)) and len(index) == sum(map(len, places.values()))


def test_ngram_join_in_slices_is_exact(spark, monkeypatch):
    monkeypatch.setattr(overlap, "SLICE_ITEMS", 3)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(x if rng.random() < 0.995 else f"v{rng.randrange(99)}" for x in base) for _ in range(60)]
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    union = brute(sets)
    got = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, union.top(i)) for i in sets}


def test_postings_of_one_token_are_spread(spark):
    rng = np.random.default_rng(4)
    keys = rng.integers(1, 1 << 62, 4000)
    common = np.uint64(77 << 40)
    tokens = np.where(np.arange(4000) % 3 == 0, common, rng.integers(1 << 40, 1 << 60, 4000)).astype(np.uint64)
    tokens[1:199:3] = tokens[2:200:3]
    hot = np.array([common], np.uint64)
    blobs = []
    for part in (slice(0, 2500), slice(1500, 4000)):
        packer = postings.Packer(16, hot)
        batches = [*packer.add(tokens[part], keys[part]), *packer.flush()]
        blobs += [(r["bucket"], r["payload"]) for b in batches for r in b.to_pylist()]
    sizes = collections.Counter()
    for bucket, payload in blobs:
        sizes[bucket] += len(payload) // 16
    assert max(sizes.values()) < 600 and sum(sizes.values()) == 5000
    got = [(r.token, r.k) for r in postings.shared_tokens(spark.createDataFrame(blobs, postings.SCHEMA), hot).collect()]
    counts = collections.Counter(tokens.tolist())
    assert sorted(got) == sorted((t, k) for t, k in zip(tokens.tolist(), keys.tolist()) if counts[t] > 1)


def test_stars_of_a_common_band_are_joined_over_tasks():
    rng = np.random.default_rng(6)
    tokens = np.where(np.arange(3000) % 3 == 0, 5, rng.integers(10, 2000, 3000))
    rows = np.column_stack((tokens, rng.integers(1, 1 << 40, 3000) | 1))
    parts = [line_dedup.stars(p) for p in np.array_split(np.concatenate((rows, rows[:50])), 7)]
    sent = np.concatenate([rest for _, _, rest in parts])
    assert (np.unique(sent[:, 0], return_counts=True)[1] <= 7).all()
    last, alone, _ = line_dedup.stars(sent)
    holders = collections.Counter(t for t, _ in {tuple(r) for r in rows.tolist()})
    assert alone.any() and all(holders[t] == 2 for t in last[alone, 0].tolist())
    found = np.concatenate([f for f, _, _ in parts] + [last])
    union, want = Union(), Union()
    for t, k, c in found.tolist():
        union.join((t, k), (t, c))
    least: dict = {}
    for t, k in rows.tolist():
        want.join((t, k), (t, least.setdefault(t, k)))
    several = {t for t in least if sum(1 for x, _ in want if x == t) > 1}
    assert {x for x in want if x[0] in several} == set(union)
    assert len({union.top(x) for x in union}) == len(several) and all(union.top(x)[0] == x[0] for x in union)


def test_ngram_join_of_nothing_and_nulls(spark):
    schema = "doc_id long, text string"
    assert ngram_join.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (None, None), (4, "a b c d e f"), (4, "a b c d e f"), (4, "q r s t u v")]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(4, 4)] * 3 and len(got) == 5


@pytest.mark.parametrize("ids", ["null", "shared", "own"])
def test_many_near_copies_of_any_ids(spark, ids):
    """Rows that share an id, or have none, are told apart by their texts, and cost what others cost."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:20], f"x{k}", *words[21:]]) for k in range(600)] + [" ".join(words)] * 300 + ["z " * 10**6, None, ""]
    rows = [(None if ids == "null" else 5 if ids == "shared" else i, t) for i, t in enumerate(texts)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("n_shingles", "component_id").count().collect()
    one = {"null": None, "shared": 5, "own": 0}[ids]
    assert [(r["count"], r.component_id) for r in got if r.n_shingles == 56] == [(900, one)] and sum(r["count"] for r in got) == len(texts)


def test_long_lists_are_probed(monkeypatch):
    rng = np.random.default_rng(3)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(100) < p, rng.integers(200, 900, 100).astype(np.uint64), base)) for p in (0, 0.02, 0.05, 0.08, 0.1, 0.3) for _ in range(8)]
    block = overlap.Block(sets)
    for s in sets:
        want = [i for i, o in enumerate(sets) if 100 * len(np.intersect1d(s, o)) >= 80 * len(np.union1d(s, o))]
        assert block.search(s, 80).tolist() == want
    assert block.probed > 0  # at the constants that queries use
    monkeypatch.setattr(overlap, "ENTRIES", 900)
    pairs = set(zip(*(x.tolist() for x in block.links(sets[:30] + [np.array([5000], np.uint64)], 80))))
    assert pairs == {(i, j) for i in range(30) for j in block.search(sets[i], 80).tolist()}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (None, 1)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100} | {200 + i: 100 for i in range(30)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_edges_take_few_jobs(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)], "a long, b long")
    spark.sparkContext.setJobGroup("few_edges", "")
    try:
        got = components.components(edges).collect()
    finally:
        spark.sparkContext.setJobGroup("others", "")
    assert len(got) == 72 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("few_edges")) <= 6  # each round of stars took 6 and more


def test_components_of_edges_in_several_tasks(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + (i * 37) % 101, 1000 + (i * 37 + 37) % 101) for i in range(100)]
    union = Union()
    for a, b in edges:
        union.join(a, b)
    monkeypatch.setattr(components, "ROWS_PER_TASK", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    least = {}
    for x in {x for e in edges if e[0] != e[1] for x in e}:
        least[union.top(x)] = min(x, least.get(union.top(x), x))
    assert {r.node: r.root for r in got} == {x: least[union.top(x)] for e in edges if e[0] != e[1] for x in e} and len(got) == len({r.node for r in got})


def test_components_of_several_tasks_take_few_jobs(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 2000 + i) for i in range(200)] + [(5000 + i, 5001 + i) for i in range(0, 100, 2)]
    random.Random(5).shuffle(edges)
    monkeypatch.setattr(components, "ROWS_PER_TASK", 250)
    spark.sparkContext.setJobGroup("more_edges", "")
    try:
        got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        spark.sparkContext.setJobGroup("others", "")
    want = {i: 0 for i in range(301)} | {1000: 1000} | {2000 + i: 1000 for i in range(200)} | {5000 + i: 5000 + i // 2 * 2 for i in range(100)}
    n_jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("more_edges"))
    assert got == want and n_jobs <= 20, n_jobs


def test_block_links_leave_out_long_lists():
    rng = np.random.default_rng(6)
    base = [np.unique(rng.integers(0, 400, 150, dtype=np.uint64)) for _ in range(40)]
    sets = [np.union1d(b[rng.random(len(b)) > p], np.unique(rng.integers(400, 800, k, dtype=np.uint64))) for b in base for p, k in ((0, 1), (0.1, 4), (0.2, 9))]
    sets += [np.array([7], np.uint64), np.array([7, 9000], np.uint64), np.arange(50, 54, dtype=np.uint64), np.arange(50, 55, dtype=np.uint64)]
    shared = lambda a, b: len(np.intersect1d(a, b))
    block = overlap.Block(sets)
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 100 * (s := shared(a, b)) >= 80 * (len(a) + len(b) - s)}
    block.items = seen = Counted(block.items)
    assert set(zip(*(x.tolist() for x in block.links(sets, 80)))) == want and len(want) > len(sets)
    assert seen.entries < sum(np.isin(a, b).sum() for a in sets for b in sets) / 2


class Counted:
    """An array that counts what is taken from it."""

    def __init__(self, array):
        self.array, self.entries = array, 0

    def __getitem__(self, at):
        self.entries += len(at)
        return self.array[at]


def test_line_dedup_sends_rows_of_many_small_blocks_at_once():
    star = [np.array([[i, 2 * i + 1, 1]], np.int64).tobytes() for i in range(200)]
    blobs = [pa.RecordBatch.from_pydict({"bucket": pa.array([0] * 20, pa.int32()), "kind": pa.array([line_dedup.STAR] * 20, pa.int8()), "payload": pa.array(star[i : i + 20], pa.binary())}) for i in range(0, 200, 20)]
    got = list(line_dedup._gather(iter(blobs)))
    assert len(got) == 1 and got[0].column("a").to_pylist() == list(range(200))
    rows = [(i, 0, asks, 16 * i + 1 + 4 * asks, f"a line of some length, number {i}") for i in range(100) for asks in (0, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()))], names=["block", "slice", "asks", "item", "body"])
    got = list(line_dedup._search(80)(iter([batch])))
    assert len(got) == 1 and sorted(zip(*(c.to_pylist() for c in got[0].columns))) == [(16 * i + 5, 16 * i + 1) for i in range(100)]


def test_line_dedup_of_many_lines_shuffles_no_texts(spark, monkeypatch):
    rng = random.Random(11)
    lines = [" ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(10)) for _ in range(40)]
    texts = ["\n".join((x, f"{i} " + rng.randbytes(40_000).hex(), x[:40] + "zé" + x[42:])) for i, x in enumerate(lines)]
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string").repartition(3).localCheckpoint()
    monkeypatch.setattr(line_dedup, "MOST_BESIDE", 0)
    written = lambda: sum(x.totalShuffleWrite() for x in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(True)))
    before = written()
    got = line_dedup.dedup_lines(docs).collect()
    assert written() - before < sum(map(len, texts)) / 4
    assert len(got) == 41 and all(r.kept_text == r.text[: r.text.rindex("\n")] for r in got)


def test_bodies_are_those_of_the_places_asked_for(spark):
    texts = ["\n".join(f"line {j} of text {i} é" for j in range(40)) + "\n" * (i % 3) for i in range(60)]
    keyed = spark.createDataFrame([(i or None, t) for i, t in enumerate(texts)], "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("th"), "text")
    asked = [(i, j) for i in range(60) for j in range(i % 5)]
    pos = {i: [j for k, j in asked if k == i] for i in range(60)}
    spots = keyed.join(spark.createDataFrame([(i or None, pos[i]) for i in pos], "e long, at array<int>"), F.col("doc_id").eqNullSafe(F.col("e"))).select(F.col("doc_id").alias("d"), "th", F.explode("at").alias("pos"))
    got = line_dedup.bodies_of(keyed, spots.localCheckpoint()).collect()
    want = {texts[i].split("\n")[j] for i, j in asked}
    assert {r.body for r in got} >= want and len(got) < len(want) + 100
    assert [r.k for r in got] == line_dedup.line_sets([r.body for r in got], np.zeros(len(got), np.int64))[0].tolist()


@pytest.mark.parametrize("items", [500, 3])
def test_bands_are_searched_by_themselves(spark, monkeypatch, items):
    monkeypatch.setattr(line_dedup, "BLOCK_ITEMS", items)
    rng = random.Random(2)
    bands = {1000 * t + 500: [10 * t + i for i in range(rng.choice([3, 5, 9]))] for t in range(1, 30)}
    bands[1] = list(range(5, 300, 60))  # one band of items of many others
    rows = [(t, k, k if t % 3 else k // 2, bands[t][0]) for t in bands for k in bands[t]]
    visits, index = line_dedup.band_visits(spark.createDataFrame(rows, "token long, k long, root long, top long"))
    visits, index = [tuple(r) for r in visits.collect()], [tuple(r) for r in index.collect()]
    met = {(a, b) for a, x in visits for b, y in index if x == y}
    assert all((k, other) in met for t, k, root, top in rows if root != top for other in bands[t])
    assert len(index) == len(set(index)) <= len(rows) and len(set(visits)) == len(visits)
    if items == 500:
        assert len(visits) <= len(rows)


def test_line_dedup_finds_edits_in_mid_line(spark):
    rng = random.Random(9)
    lines = ["".join(rng.choice("abcdefghijklmnopqrs ") for _ in range(n)).replace("  ", "xy").strip() + "." for n in range(30, 82, 2)]
    near = [x[: len(x) // 2] + "Z" + x[len(x) // 2 + 1 :] for x in lines]
    apart = ["x" + x[1:9] + y[9:] for x, y in zip(lines, lines[1:])]
    texts = ["\n".join(part) for part in (lines, near, apart)]
    got = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    windows = lambda x, k: {x[j : j + k] for j in range(max(1, len(x) - k + 1))}
    every = {x for t in texts for x in t.split("\n")}
    long, short = brute({x: windows(x, 5) for x in every}), brute({x: windows(x, 3) for x in every if 24 <= len(x) <= 64})
    union = Union()
    for found in (long, short):
        for x in list(found):
            union.join(x, found.top(x))
    seen, want = set(), collections.defaultdict(list)
    for i, t in enumerate(texts):
        for x in t.split("\n"):
            if union.top(x) not in seen:
                seen.add(union.top(x))
                want[i].append(x)
    assert got == {i: "\n".join(want[i]) for i in range(3)} and not want[1]


def test_line_dedup_keeps_one_of_each_component(spark):
    rng = random.Random(5)
    sentence = lambda: " ".join("".join(rng.choice("abcdeé") for _ in range(6)) for _ in range(12))
    lines = [sentence() for _ in range(30)]
    near = [x[:-1] + "z" for x in lines[:10]]
    texts = ["\n".join(rng.choices(lines + near + ["", "  ", "kurz"], k=8)) for _ in range(40)] + ["", None, "\n\n"]
    rows = [(i, t, "kept") for i, t in enumerate(texts)] + [(3, texts[3], "kept")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, kept_text string")).collect()
    every = {x for t in texts if t for x in t.split("\n") if x.strip()}
    union = brute({x: {x[j : j + 8] for j in range(max(1, len(x) - 7))} for x in every})
    seen, want = set(), collections.defaultdict(list)
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            root = union.top(x) if x.strip() else None
            if root is None or root not in seen:
                want[i].append(x)
                seen |= {root} - {None}
    assert len(got) == len(rows)
    for r in got:
        assert r.kept_text == (None if r.text is None else "\n".join(want[r.doc_id]))
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
