"""Operators that work on a row at a time, and searches, on small fixtures with odd rows."""

import hashlib
import itertools
import math
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import arrow_text, bpe, chat, fingerprints, mixing, pii, quality, topk, toxicity

ODD = ["", None, " ", "a", "naïve 漢字 🎉 text", "x" * 3000, "it's 12½ o'clock\n\n\n  then", "<|endoftext|>y"]
SCHEMA = "doc_id long, text string, source string, score double"


def docs(spark, texts=ODD):
    return spark.createDataFrame([(i, t, "s", 0.5) for i, t in enumerate(texts)] + [(None, "null id", None, None)], SCHEMA)


def test_fingerprints_against_plain_strings(spark):
    texts = ["the quick brown fox jumps over the lazy dog " * k for k in (1, 3, 9)] + ODD
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs(spark, texts)).collect()}
    order = [None, *range(len(texts))]
    plain = {None: "null id"} | {i: t or "" for i, t in enumerate(texts)}
    assert list(got) and set(got) == set(order)
    for at, i in enumerate(order):
        t, n = plain[i], plain[order[(at + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        common = next((k for k, (a, b) in enumerate(zip(t, n)) if a != b), min(len(t), len(n)))
        assert r.common_next == common and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) == (t == edited)
    assert fingerprints.fingerprint_documents(docs(spark).limit(0)).count() == 0


def test_span_equality_and_extensions():
    rng = np.random.default_rng(1)
    powers = fingerprints.Powers()
    a = rng.integers(97, 99, 300).astype(np.uint32)
    h = fingerprints.PrefixHash(a, powers)
    for i, j, n in rng.integers(0, 100, (200, 3)).tolist():
        assert (h.span(i, i + n) == h.span(j, j + n)) == (a[i : i + n] == a[j : j + n]).all()


RULES = ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))), (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[ -]", "", m)) <= 19 and pii.luhn(d)), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15))


def test_pii_rules_against_regexes():
    rng = np.random.default_rng(2)
    parts = ["a@b", "@", ".c", "x.y@z-w.de.fr", "1", "12", "256", ".", " ", "-", "+", "+1 (414) 555-3519", "4111111111111111", "4111 1111-1111 1111", "10.0.0.1", "(", "é"]
    for _ in range(3000):
        t = "".join(rng.choice(parts, rng.integers(1, 9)))
        want = sorted(((m.start(), m.end(), k) for k, (p, ok) in enumerate(RULES) for m in re.finditer(p, t) if ok(m[0])), key=lambda s: (s[0], s[2]))
        assert pii.base_spans(t) == want, t


def test_tagger_learns_spans_and_gradients():
    rng = np.random.default_rng(7)
    tagger = pii.Tagger(4, 5)
    codes, tags = rng.integers(0, pii.N_CODES, (3, 7)), rng.integers(0, len(pii.TAGS), (3, 7))
    grads = tagger.gradients(codes, tags)

    def loss():
        e, _ = tagger.emissions(codes)
        z, _, _ = tagger.marginals(e)
        gold = sum(e[t, np.arange(3), tags[:, t]] for t in range(7)) + tagger.p["trans"][tags[:, :-1], tags[:, 1:]].sum(axis=1)
        return (z - gold).mean()

    for name, g in grads.items():
        at = tuple(rng.integers(0, s) for s in g.shape)
        before = tagger.p[name][at]
        tagger.p[name][at] = before + 1e-5
        up = loss()
        tagger.p[name][at] = before - 1e-5
        down = loss()
        tagger.p[name][at] = before
        assert abs((up - down) / 2e-5 - g[at]) < 1e-5, name


def test_pii_keeps_rule_spans(spark):
    texts = [*ODD, "mail a.b@c.example.com or +1 (414) 555-3519 from 10.0.0.1, card 4111111111111111"] * 6
    found = pii.find_pii(docs(spark, texts), pii.fit(docs(spark, texts))).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        if r.doc_id is not None:
            assert [(s.start, s.end) for s in r.found if not s.learned] == [s[:2] for s in pii.base_spans(texts[r.doc_id] or "")]
    assert pii.fit(docs(spark, ["no digits"])) is None and pii.find_pii(docs(spark).limit(0), None).count() == 0


def test_pii_rules_take_linear_time_and_long_zero_runs():
    assert pii.base_spans("x " + "0" * 5000 + "1.0.0.1")[-1] == (2, 5009, 1)
    began = time.time()
    for text in ("7" * 10**6, "1." * 10**5 + "x", "+1" + " " * 10**5, "a" * 10**5 + "@", "12 " * 10**5, "@a." * 10**5):
        pii.base_spans(text)
    assert time.time() - began < 3


def test_viterbi_and_marginals_against_all_paths():
    rng = np.random.default_rng(5)
    tagger = pii.Tagger(4, 5)
    tagger.p["trans"] = rng.normal(size=(9, 9))
    codes = rng.integers(0, pii.N_CODES, (2, 4))
    e, _ = tagger.emissions(codes)
    path, sure = tagger.decode(codes)
    for row in range(2):
        every = {tags: sum(e[t, row, x] for t, x in enumerate(tags)) + sum(tagger.p["trans"][a, b] for a, b in zip(tags, tags[1:])) for tags in itertools.product(range(9), repeat=4)}
        best = max(every, key=every.get)
        assert tuple(path[row]) == best
        total = np.log(sum(np.exp(v) for v in every.values()))
        for t in range(4):
            assert abs(sure[row, t] - sum(np.exp(v - total) for tags, v in every.items() if tags[t] == best[t])) < 1e-9


def test_windows_are_reconciled_by_the_middle_most():
    tagger = pii.Tagger(4, 5, seed=8)
    tagger.p["out"] *= 4
    texts = ["call 414 555 3519 or +49 30 123 or mail a(at)b " * 6, "1" * 150, "7 " + "x" * 300 + " 8", "", "@"]
    want = []
    for t in texts:
        votes: dict = {}
        for a, b in pii.windows(t):
            codes = np.zeros((1, pii.WINDOW), np.int64)
            codes[0, : b - a] = pii.encode(t[a:b])
            path, sure = tagger.decode(codes)
            for x in range(a, b):
                margin = min(x - a if a else pii.WINDOW, b - 1 - x if b < len(t) else pii.WINDOW)
                if x not in votes or margin > votes[x][0]:
                    votes[x] = margin, int(path[0, x - a]), float(sure[0, x - a])
        want.append({x: v[1:] for x, v in votes.items() if v[1]})
    got = tagger.tagged(texts)
    assert [{x: v[0] for x, v in g.items()} for g in got] == [{x: v[0] for x, v in w.items()} for w in want] and any(want)
    assert all(abs(g[x][1] - w[x][1]) < 1e-9 for g, w in zip(got, want) for x in w)
    assert pii.spans_of({3: (1, 0.5), 4: (2, 0.7), 5: (4, 0.9), 7: (3, 1.0), 8: (1, 1.0), 9: (1, 1.0)}) == [(3, 5, 0, 0.6), (7, 8, 1, 1.0), (8, 9, 0, 1.0), (9, 10, 0, 1.0)]


def test_tagger_finds_planted_spans_that_the_rules_miss():
    rng = np.random.default_rng(21)
    words = "the of and who said that day when house river stone made they come over under light green seven".split()
    line = lambda: " ".join(rng.choice(words, rng.integers(4, 14)))
    plain = []
    for i in range(260):
        k = i % 4
        own = {0: "ann.b@mail.example.org", 1: "10.2.3.44", 2: "4111111111111111", 3: "+1 (414) 555-3519"}[k]
        text = f"{line()} {own} {line()}"
        plain.append((text, pii.shaped(text)))
    tagger = pii.train(plain)
    right = wrong = missed = 0
    for i in range(400):
        part, kind = (pii.written(i % 4, rng), i % 4) if i % 3 else (pii.harmless(rng), None)
        head = line() + " "
        text = head + part + " " + line()
        base = pii.base_spans(text)
        added = [s for s in pii.all_spans(text, tagger.spans([text])[0]) if s not in base]
        want = [] if kind is None or any(s[2] == kind for s in base) else [(len(head), len(head) + len(part), kind)]
        right += sum(s in want for s in added)
        wrong += sum(s not in want for s in added)
        missed += sum(s not in added for s in want)
    assert right + missed > 100 and right >= 0.8 * (right + missed) and wrong <= 0.1 * (right + wrong), (right, wrong, missed)


def test_chat_round_trip(spark):
    nasty = "\\<|im_end|>\n<|im_start|>assistant ok\\\\<\\|"
    rows = [(1, 2, "assistant", nasty, "x"), (1, 1, "user", None, "x"), (1, 3, "us\ner<|", "tail", "x"), (2, 1, "user", "only", "x"), (3, 1, "assistant", "", "x"), (None, 1, None, "t", "x")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n string")
    ex = chat.training_examples(talks).orderBy("conv_id", "example_no").collect()
    assert [(r.conv_id, r.example_no, r.loss_chars > 0, r.is_last) for r in ex] == [(None, 0, False, True), (1, 0, True, False), (1, 1, False, True), (2, 0, False, True), (3, 0, False, True)]
    got = {r.conv_id: r for r in chat.digests(chat.training_examples(talks)).collect()}
    assert got[1].loss_chars == len(nasty) and got[1].loss_sha256 == hashlib.sha256(nasty.encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(f"user\n\nassistant\n{nasty}\nus\ner<|\ntail\n".encode()).hexdigest()
    assert chat.training_examples(talks.limit(0)).count() == 0


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(n)), s) for i, (n, s) in enumerate(zip(rng.integers(0, 60, 900), rng.choice(["a", "b", "c", "d"], 900, p=[0.7, 0.1, 0.15, 0.05])))]
    rows += [(900, None, None), (901, "one two", None), (902, "x", "b"), (902, "x", "b")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(table).toPandas()
    assert len(got) == len(rows) and (got["copies"] <= 3).all()
    sums = got.assign(taken=got["size"] * got["copies"], source=got["source"].fillna("~")).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(sums["taken"] - sums["target"]) <= 60).all() and (sums["target"] <= 3 * sums["size"] + 1e-6).all()
    assert abs(sums["target"].sum() - got["size"].sum()) < 1e-6
    again = mixing.mix_sources(table.repartition(5)).toPandas()
    key = ["doc_id", "source", "copies"]
    assert sorted(map(repr, got[key].values.tolist())) == sorted(map(repr, again[key].values.tolist()))
    assert mixing.mix_sources(table.limit(0)).count() == 0


def test_top_k_against_all_scores(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_BLOCK", 50)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(6)
    rows = [(i, (rng.integers(-70, 70, 9) / 64).tolist()) for i in range(160)] + [(500 + i, [0.5] * 9) for i in range(30)] + [(700, None), (701, [None] * 9), (702, [float("nan")] * 9), (703, []), (704, [float("inf")] * 9)]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    whole = {r.vec_id: np.array(r.v) for r in vectors.collect()}
    assert set(whole) == set(range(160)) | set(range(500, 530))
    got = topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20).collect()
    for q in (i for i in whole if i % 20 == 0):
        want = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:20]
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    few = vectors.where("vec_id < 3")
    assert topk.top_k(few, few, 20).count() == 6 and topk.top_k(vectors.limit(0), few, 20).count() == 0


def test_top_k_of_rows_that_share_an_id(spark):
    """Each row of an id is a query of its own, and a candidate of the others."""
    rng = np.random.default_rng(8)
    rows = [(i % 40, rng.integers(-70, 70, 6).astype(float).tolist()) for i in range(90)] + [(0, [1.0] * 6)] * 3
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    whole = [(r.vec_id, np.array(r.v)) for r in vectors.collect()]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20).collect())
    want = []
    for at, (q, own) in enumerate(whole):
        if q % 20 == 0:
            best = sorted((-int(own @ v), i) for j, (i, v) in enumerate(whole) if j != at)[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(9)
    for size in (1e6, 1e10, 1e300):
        rows = [(i, (rng.normal(size=7) * (size if i % 3 else 1.0)).tolist(), "x") for i in range(90)] + [(90, [size, -size] * 3 + [0.0], "x"), (20, [1.0] * 7, "x")]
        vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string"))
        whole = [(r.vec_id, [int(x) for x in r.v]) for r in vectors.collect()]
        assert len(whole) == 92 and max(abs(x) for _, v in whole for x in v) <= 2**62
        got = topk.top_k(vectors, vectors.where("vec_id % 30 = 0"), 20).collect()
        for q, own in whole:
            if q % 30 == 0:
                held = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(own, v)))), i) for i, v in whole if i != q]
                assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(sorted(held)[:20])], (size, q)


def test_impact_index_stops_on_proof_only():
    rng = np.random.default_rng(3)
    for spread in (2, 40, 3000):
        vectors = np.floor(rng.standard_t(2, (3000, 12)) * spread).astype(np.int64)
        vectors[100:130] = vectors[0]
        index = topk.ImpactIndex(np.arange(3000), vectors)
        sizes = [x for runs, _, _ in index.segments for x in [min(abs(v).min() for _, _, v in runs), max(abs(v).max() for _, _, v in runs)]]
        assert sizes == sorted(sizes, reverse=True) or all(a >= c for a, c in zip(sizes[::2], sizes[3::2]))
        assert sum(len(v) for runs, _, _ in index.segments for _, _, v in runs) == np.count_nonzero(vectors)
        asked = np.arange(0, 3000, 50)
        for q, (ids, scores) in zip(asked, index.search(vectors[asked], asked, 20)):
            exact = vectors @ vectors[q]
            want = sorted((-int(s), i) for i, s in enumerate(exact) if i != q)[:20]
            assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist())] == want


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_path()
    library = tokenizers.Tokenizer.from_file(path)
    texts = [*ODD, "ab" * 400, "é" * 90, " " * 70 + "b", "<|endoftext|>" * 2, "\x1c\x85 x"]
    for r in bpe.encode_documents(docs(spark, texts), path).collect():
        text = "null id" if r.doc_id is None else texts[r.doc_id] or ""
        assert r.ids == library.encode(text, add_special_tokens=False).ids
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    model = bpe.BPE(bpe.read_tables(path))
    for word in (b"internationalization", b"aaaaaaaaaaaaaaaa", b"ab"):
        assert model._long(word) == model._forest([word], 32)[0]


def test_bpe_equals_the_library_on_a_whole_table(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_path()
    library = tokenizers.Tokenizer.from_file(path)
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = spark.createDataFrame([(-1, "ab" * 50_000), (-2, "x" * 100_000)], "doc_id long, text string")
    for rows in (table, long):
        ids = {r.doc_id: r.ids for r in bpe.encode_documents(rows, path).collect()}
        for r in rows.collect():
            assert ids[r.doc_id] == library.encode(r.text or "", add_special_tokens=False).ids, r.doc_id


def test_toxicity_folds_and_spares():
    lexicon = toxicity.Lexicon({"idiot": 4.0, "trash": 3.0, "lowe*": 2.0})
    score = lambda t: lexicon.features(t)[0]
    assert score("you IDIOT!") == score("you 1d10t") == score("you іdiоt") == 4.0
    assert score("the trash can") == 0.0 and score("the trash man") == 3.0 and score("idiotic") == 0.0 and score("lowering 1010") == 2.0
    assert lexicon.features("") == lexicon.features(None) == (0.0, 0.0, 0)


def test_toxicity_counts_words_of_substitutes():
    lexicon = toxicity.Lexicon({t: 4.0 for t in toxicity.SEED_TERMS} | {"lowe*": 2.0, "tool*": 2.0, "soss": 2.0})
    for text in ("you 1d107", "you 455h0l3", "you @$$h0l3!", "an !d!07 then", "$7up1d", "|0$3r", "the 7r4$h man"):
        assert lexicon.features(text)[0] == 4.0, text
    for text in ("7001 and 70017", "in 5055 of 10107", "70,017", "the 7r4$h can"):
        assert lexicon.features(text) == (0.0, 0.0, 0), text


def labelled(spark, good, bad, label, n=120):
    rows = [(i, (bad if i % 3 == 0 else good)(i), int(i % 3 == 0)) for i in range(n)]
    return spark.createDataFrame([(i, t) for i, t, _ in rows] + [(n, None), (n + 1, "")], "doc_id long, text string"), spark.createDataFrame([(i, y if label == "toxic" else 1 - y) for i, _, y in rows] + [(None, 1), (9999, 1), (0, None)], f"doc_id long, {label} int")


def test_toxicity_learns_from_labels(spark):
    table, labels = labelled(spark, lambda i: f"plain words number {i} of a text " * 5, lambda i: f"plain words you zorgling{i % 2} there " * 5, "toxic")
    scored = toxicity.fit(table, labels).score(table).toPandas().set_index("doc_id")["score"]
    assert all((scored[i] >= 0.5) == (i % 3 == 0) for i in range(120)) and scored[120] < 0.5
    assert toxicity.fit(table, labels.limit(0)).score(table.limit(0)).count() == 0


def test_quality_learns_from_labels(spark):
    table, labels = labelled(spark, lambda i: f"A calm sentence of plain words follows here, number {i}. " * 9, lambda i: "BUY!! NOW!! " * (20 + i % 5), "quality")
    scored = quality.fit(table, labels).score(table).toPandas().set_index("doc_id")["score"]
    assert all((scored[i] >= 0.3) == (i % 3 != 0) for i in range(120)) and scored.between(0, 1).all()
    assert quality.fit(table, labels.limit(0)).score(table).count() == 122


def test_quality_forward_against_loops():
    texts = ["One two three. " * 90, "", "word", "BUY now!! 50% off " * 30, "é à 漢字 " * 40]
    column = pa.array(texts)
    owner, x = quality.passages(*arrow_text.utf8(column))
    assert owner.tolist() == [0] * 5 + [1, 2] + [3] * 2 + [4] * 2 and not x[5].any()
    model = quality.AttentionModel()
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    got, p = model.forward(owner, x, len(texts)), model.p
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    for row in range(len(texts)):
        bags, raw = [], []
        for i in np.flatnonzero(owner == row):
            unit = [min(6, max(-6, (x[i, j] - model.mean[j]) / model.scale[j])) for j in range(quality.N_FEATURES)]
            h = [math.tanh(sum(unit[j] * p["E"][j, c] for j in range(len(unit))) + p["e"][c]) for c in range(quality.HIDDEN)]
            gate = [math.tanh(sum(h[j] * p["V"][j, c] for j in range(len(h)))) * sigmoid(sum(h[j] * p["U"][j, c] for j in range(len(h)))) for c in range(quality.HIDDEN)]
            bags.append(h)
            raw.append(sum(g * w for g, w in zip(gate, p["w"])))
        weight = [math.exp(r) / sum(map(math.exp, raw)) for r in raw]
        z = [sum(a * h[c] for a, h in zip(weight, bags)) for c in range(quality.HIDDEN)]
        assert abs(got["score"][row] - sigmoid(sum(v * c for v, c in zip(z, p["c"])) + p["b"][0])) < 1e-6


def test_toxicity_matches_against_plain_search():
    rng = np.random.default_rng(12)
    terms = {"idiot": 4.0, "scum": 3.0, "scu*": 1.5, "trash": 2.0, "id": 0.5}
    exceptions = ("pond scum", "trash can", "can trash")
    lexicon = toxicity.Lexicon(terms, exceptions)
    parts = ["idiot", "1d10t", "scum", "5cum", "scumming", "pond", "trash", "can", "id", " ", " ", " ", ",", "x", "7"]
    for _ in range(2000):
        text = "".join(rng.choice(parts, rng.integers(1, 12)))
        folded = toxicity.fold(text)
        spans, spared = [], []
        for i in range(len(text)):
            for word, weight in [*terms.items(), *((e, None) for e in exceptions)]:
                stem, j = word.rstrip("*"), i + len(word.rstrip("*"))
                if folded[i:j] != toxicity.fold(stem) or (i and text[i - 1].isalnum()) or (not word.endswith("*") and j < len(text) and text[j].isalnum()):
                    continue
                if weight is None:
                    spared.append((i, j))
                elif any(c.isalpha() or c in toxicity.SIGNS for c in text[i:j]):
                    spans.append((i, -weight, -j))
        total, n, done = 0.0, 0, -1
        for i, weight, j in sorted(spans):
            if i >= done and not any(a <= i and -j <= b for a, b in spared):
                total, n, done = total - weight, n + 1, -j
        assert lexicon.features(text)[::2] == (total, n), text


def test_toxicity_takes_linear_time():
    lexicon = toxicity.Lexicon({t: 4.0 for t in toxicity.SEED_TERMS})
    began = time.time()
    assert lexicon.features("trash can " * 40_000) == (0.0, 0.0, 0) and lexicon.features("trash can idiot " * 40_000)[2] == 40_000
    assert time.time() - began < 5


def test_fingerprint_likeness_is_the_jaccard_index_of_short_texts(spark):
    texts = ["the quick brown fox jumps over it", "the quick brown fox jumped over it", "short", "short", "", "x" * 12]
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    spans = lambda t: {t[j : j + 12] for j in range(max(1, len(t) - 11))} if t else set()
    for i, t in enumerate(texts):
        n = texts[(i + 1) % len(texts)]
        a = spans(t)
        for other, near in ((spans(n), got[i].near_next), (spans(t[: len(t) - len(t) // 4] + n[: len(t) // 4]), got[i].near_edited)):
            assert abs(near - (len(a & other) / len(a | other) if a | other else 1.0)) < 1e-9


def test_searches_and_scores_of_odd_rows_and_clashing_names(spark):
    long = "word and 123 " * 60_000
    rows = [(1, long, 0.5, "x"), (1, long, 0.5, "x"), (2, None, None, None), (None, "", 0.1, "y"), (3, "you 1d10t mail a (at) b.org", 0.2, "z")]
    names = "doc_id long, text string, score double, {} string"
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 0), (3, 1, 0), (None, 1, 1)], "doc_id long, toxic int, quality int")
    for name, run in {
        "found": lambda t: pii.find_pii(t, pii.fit(t)), "n_hits": lambda t: toxicity.fit(t, labels).score(t), "y": lambda t: quality.fit(t, labels).score(t),
        "d": fingerprints.fingerprint_documents, "ids": lambda t: bpe.encode_documents(t, bpe.default_path()), "copies": mixing.mix_sources,
    }.items():
        table = spark.createDataFrame(rows, names.format(name)).withColumn("source", F.lit("s"))
        assert sorted(str(r.doc_id) for r in run(table).collect()) == ["1", "1", "2", "3", "None"], name
        assert run(table.limit(0)).count() == 0, name


def test_attention_gradients():
    rng = np.random.default_rng(8)
    model = quality.AttentionModel()
    owner, x, y = np.array([0, 0, 1, 2, 2, 2]), rng.normal(size=(6, quality.N_FEATURES)), np.array([1.0, 0.0, 1.0])
    grads = model.gradients(owner, model.forward(owner, x, 3), y)

    def loss():
        p = model.forward(owner, x, 3)["score"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, g in grads.items():
        at = tuple(rng.integers(0, s) for s in g.shape)
        before = model.p[name][at]
        model.p[name][at] = before + 1e-5
        up = loss()
        model.p[name][at] = before - 1e-5
        down = loss()
        model.p[name][at] = before
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6, name
