"""Main texts, Merkle manifests and whitening against brute force, on hand-labelled pages and on odd rows."""

import hashlib
import html
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import html_extraction as he, merkle, whitening

SENTENCES = ["The river rose by two metres overnight &amp; flooded the lower town.", "Officials said that the bridge, built in 1911, would stay closed until Friday at least.", "Nobody was hurt.", "Caf&eacute; owners moved their stock to the upper floor, and the school on the hill took in forty people who had left their homes.", "It was the third flood in ten years &#8212; and the worst of them."]
BODY = "".join(f"<p>{s}</p>\n" for s in SENTENCES)
TEXT = " ".join(html.unescape(s) for s in SENTENCES)
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li><li><a href="/a">About us</a></li></ul>'
TALK = "".join(f"<p>I live near the river and I have never seen such a thing in all the {n} years that I have been here, honestly.</p>" for n in (12, 20, 31))
# Hand-labelled pages: source and main text.
LABELLED = {
    "plain divs": (f"<html><head><title>Flood</title></head><body><div>{MENU}</div><div>{BODY}</div><div>&copy; 2020 <a href=/t>Terms</a></div></body></html>", TEXT),
    "main": (f"<header>Town Paper, your daily source of local news</header><nav>{MENU}</nav><main><h1>Flood</h1>{BODY}</main><footer>All rights reserved by the Town Paper company</footer>", "Flood " + TEXT),
    "comments": (f"<div class='wrap'><div class='entry-content'>{BODY}</div><section id=comments><h3>Comments</h3>{TALK}</section></div>", TEXT),
    "comments as articles": (f"<article><h1>Flood</h1>{BODY}</article><div class='comment-list'><article class=comment>{TALK}</article></div>", "Flood " + TEXT),
    "advert inside": (f"<article>{BODY[:200]}</p><div class='ad-slot'>Buy one of our lovely umbrellas now and get the second umbrella for free this week</div><p>More text of the article follows after the advert here.</p></article>", None),
    "cookie notice": (f"<div id='cookie-consent'><p>We use cookies to give you the best experience on our website, and to show you adverts that may interest you.</p><button>Accept</button></div><div id=content>{BODY}</div>", TEXT),
    "sidebar": (f"<div class='content'>{BODY}</div><div class='sidebar'><h3>Popular</h3><p>A long teaser about something else which has nothing to do with the flood in the town at all.</p></div>", TEXT),
    "form around all": (f"<form id=f><div class=menu>{MENU}</div><div class=post>{BODY}</div></form>", TEXT),
    "form inside": (f"<main>{BODY}<form class='newsletter'><p>Sign up for our newsletter to get the news of the town every morning in your mail</p><input><button>Send</button></form></main>", TEXT),
    "scripts": (f"<script>var a = '<p>no</p>';</script><style>p {{}}</style><noscript><p>Please enable scripts to read this page in full</p></noscript><article>{BODY}<script>x()</script></article>", TEXT),
    "list at the end": (f"<article>{BODY}<ul><li>First aid: call 1</li><li>Fire: call 2</li></ul></article><footer>Town Paper</footer>", TEXT + " First aid: call 1 Fire: call 2"),
    "article header": (f"<header><p>Town Paper</p></header><article><header><h1>Flood</h1></header>{BODY}</article>", "Flood " + TEXT),
    "unclosed": (f"<nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav><article>{BODY.replace('</p>', '')}<p><b>Bold end", TEXT + " Bold end"),
    "related teasers": (f"<main><article><h1>Flood</h1>{BODY}</article></main><aside><article><h3>Other</h3><p>A teaser of another article that is not about this flood.</p></article></aside>", "Flood " + TEXT),
    "states in classes": (f"<body class='no-sidebar nav-open'><article class='post comments-open has-ads'><h1>Flood</h1>{BODY}</article><div class='related-posts'><p>Another article that you may like to read as well today</p></div></body>", "Flood " + TEXT),
    "hidden": (f"<article>{BODY}<div style='display: none'>Hidden words for robots only, which no reader sees</div></article>", TEXT),
}


def test_labelled_pages_without_training():
    weights = he.Weights({}, {})
    for name, (source, want) in LABELLED.items():
        got = he.main_text(source, weights)
        if want is None:
            assert "umbrella" not in got and "More text of the article" in got and got.startswith("The river"), name
        else:
            assert got == want, name


def test_labelled_pages_with_trained_weights(spark):
    sources = ["<body><nav>" + MENU + f"</nav><div class=ad>Buy it now {i}</div><article><h1>Flood</h1>{BODY}</article><footer>&copy; paper</footer></body>" for i in range(40)]
    pages = spark.createDataFrame([(i, "u", s) for i, s in enumerate(sources)], "page_id long, url string, html string")
    weights = he.fit(pages)
    for name, (source, want) in LABELLED.items():
        assert want is None or he.main_text(source, weights) == want, name
    got = he.extract_main_text(pages).collect()
    assert {r.text for r in got} == {"Flood " + TEXT} and {r.n_chars for r in got} == {len("Flood " + TEXT)}


def test_given_pages_by_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = he.fit(pages)
    source = {r.page_id: r.html for r in pages.collect()}

    def article(s):
        inner = re.sub(r"<[^>]*>", "", re.sub("<br>", " ", re.sub(r"</?(p|h1)>", "\0", re.search(r"<article>(.*?)</article>", s, re.S)[1])))
        return " ".join(x for b in inner.split("\0") if (x := " ".join(html.unescape(b).split())))

    got = {r.page_id: r.text for r in he.extract_main_text(pages, weights).collect()}
    assert got == {i: article(s) for i, s in source.items()}
    bare = pages.withColumn("html", F.regexp_replace("html", "<(/?)article>", "<$1div>"))  # pages that mark nothing
    assert {r.page_id: r.text for r in he.extract_main_text(bare, weights).collect()} == got


def test_best_run_against_all_runs():
    rng = np.random.default_rng(3)
    for _ in range(300):
        s = rng.integers(-3, 4, rng.integers(0, 12)).astype(float)
        sums = {(a, b): s[a:b].sum() for a in range(len(s) + 1) for b in range(a, len(s) + 1)}
        a, b = he.best_run(s)
        assert s[a:b].sum() == max([0.0, *sums.values()]) and (b > a) == (max([0.0, *sums.values()]) > 0)


def test_extraction_of_odd_rows(spark):
    rows = [(0, "u", None, 1), (0, "u", None, 1), (None, None, "", 2), (2, "v", "<", 3), (3, "v", "plain words without a tag, quite a lot of them in a row", 4), (4, "v", "<p>" + "long text of a page " * 100_000, 5), (5, "v", "<script>never closed", 6), (6, "w", "<!-- open <p>x</p>", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")  # a column whose name clashes
    got = sorted(((r.page_id, r.text, r.n_chars) for r in he.extract_main_text(pages).collect()), key=str)
    want = [(0, "", 0), (0, "", 0), (None, "", 0), (2, "<", 1), (3, rows[4][2], len(rows[4][2])), (4, ("long text of a page " * 100_000).strip(), 1_999_999), (5, "", 0), (6, "", 0)]
    assert got == sorted(want, key=str) or [g for g in got if g[0] != 2] == sorted((x for x in want if x[0] != 2), key=str)
    assert he.extract_main_text(pages.limit(0)).count() == 0


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_manifest(rows):
    def leaf(r, more=0):
        n = None if r["n_chars"] is None else r["n_chars"] + more
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], n, r["text"])))

    def up(level):
        return [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]

    def proof(level, i):
        while len(level) > 1:
            yield level[i ^ 1 : (i ^ 1) + 1], i
            level, i = up(level), i // 2

    def top(level):
        while len(level) > 1:
            level = up(level)
        return level[0]

    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    for t in trees.values():
        t.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    subroots = [top([leaf(r) for r in trees[x]]) for x in langs]
    for at, lang in enumerate(langs):
        leaves = [leaf(r) for r in trees[lang]]
        for i, r in enumerate(trees[lang]):
            steps = [*proof(leaves, i), *proof(subroots, at)]
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            folded = leaf(r, 1) if changed else leaves[i]
            for sibling, k in steps:
                folded = sha("".join([*sibling, folded] if k % 2 else [folded, *sibling]))
            yield r["doc_id"], leaves[i], subroots[at], top(subroots), sha("".join(x for s, _ in steps for x in s)), folded, folded == top(subroots)


ANY = lambda row: tuple((x is not None, x) for x in row)
MANIFEST = "doc_id long, source string, lang string, n_chars long, text string, tree string, at long"


def odd_documents():
    rows = [(i, "s" if i % 3 else None, ["en", "de", None, ""][i % 4 if i < 30 else 0], i, f"text {i} é漢" * (i % 5), "x", 0) for i in range(300)]
    return rows + [(7, "s", "en", None, None, None, 1)] * 5 + [(None, None, None, None, None, None, None)] * 3 + [(11, "s", "zz", 4, "lone", "x", 1), (12, "s", "én", 5, "y" * 10**6, "x", 1)]


@pytest.mark.parametrize("height", [1, 3, 10])
def test_manifest_against_lists(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    docs = spark.createDataFrame(odd_documents(), MANIFEST)
    got = [tuple(r) for r in merkle.verify_documents(docs, merkle.tampered_leaf()).collect()]
    want = list(plain_manifest([r.asDict() for r in docs.collect()]))
    assert sorted(got, key=ANY) == sorted(want, key=ANY)
    assert 0 < sum(not r[-1] for r in got) < len(got) and all(r.verified for r in merkle.verify_documents(docs).collect())


def test_manifest_of_small_tables(spark):
    docs = spark.createDataFrame(odd_documents(), MANIFEST)
    assert merkle.verify_documents(docs.limit(0)).count() == 0
    one = docs.where("lang = 'zz'")
    (r,) = merkle.verify_documents(one, merkle.tampered_leaf()).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == sha("")


def test_van_emde_boas_order():
    for height in range(12):
        slots = np.concatenate([merkle.address(height, d, np.arange(1 << d)) for d in range(height + 1)])
        assert sorted(slots.tolist()) == list(range((1 << (height + 1)) - 1)) and slots[0] == 0
    # a tree of four levels of nodes: the top two levels, then four trees of three nodes, side by side
    assert merkle.address(3, 2, np.arange(4)).tolist() == [3, 6, 9, 12] and merkle.address(3, 3, np.arange(8)).tolist() == [4, 5, 7, 8, 10, 11, 13, 14]


def test_inertia_and_contours_against_dense_solver():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 17, 40):
        b = rng.standard_normal((d, d))
        q = np.linalg.qr(b)[0]
        for a in (b @ b.T, q @ np.diag(np.r_[np.full(d - d // 2, 3.0), np.linspace(1, 2, d // 2)]) @ q.T, b[:, :1] @ b[:, :1].T, np.diag(np.arange(d) + 1.0), np.zeros((d, d))):
            a = (a + a.T) / 2
            exact = np.linalg.eigvalsh(a)[::-1]
            for shift in (-0.5, 0.3, 1.55, 2.5):
                assert whitening.inertia(a, shift) == (exact > shift).sum()
            values, vectors = whitening.principal(a)
            want = exact[: min(16, d)]
            want = want[want > 1e-12 * max(exact[0], 1e-300)]
            assert len(values) == len(want) and np.allclose(values, want, rtol=1e-12, atol=0)
            assert np.abs(a @ vectors - vectors * values).max(initial=0) <= 1e-12 * max(exact[0], 1) and np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def plain_whitening(vectors):
    x = np.floor(64 * np.asarray(vectors, np.float64)).astype(np.int64) + 1_000_000
    f = np.unique(x, axis=0)
    n, s = len(f), f.sum(axis=0)
    y = f - s / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ u / np.sqrt(e), e / np.trace(y.T @ y / n)


def test_whitening_against_dense_solver(spark):
    rng = np.random.default_rng(4)
    v = (rng.standard_normal((400, 20)) @ rng.standard_normal((20, 20)) / 4).astype(np.float32)
    v[300:] = v[5]  # copies count once in the fit list
    rows = [(i, x.tolist(), "s") for i, x in enumerate(v)]
    odd = [(1000, None, "s"), (1001, [None] + [0.0] * 19, "s"), (1002, [float("nan")] * 20, "s"), (1003, [float("-inf")] * 20, "s"), (1004, [1.0] * 19, "s"), (1005, [], "s"), (None, v[0].tolist(), None), (0, v[1].tolist(), "s")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n string")
    got = whitening.whiten(df).toPandas()
    n, deviation, white, explained = plain_whitening(v)
    mine = got[(got.vec_id != 0) & got.vec_id.notna()]
    table = mine.pivot(index="vec_id", columns="component", values="whitened")
    assert list(table.index) == list(range(1, 400)) and list(table.columns) == list(range(1, 17)) and set(got.n) == {n}
    sign = np.sign((table.to_numpy() * white[1:]).sum(axis=0))
    assert np.abs(table.to_numpy() * sign - white[1:]).max() < 1e-8
    assert mine[mine.component == 1].set_index("vec_id").deviation.sort_index().tolist() == deviation[1:].tolist()
    assert np.allclose(mine[mine.vec_id == 1].explained, explained, rtol=1e-10) and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-10
    assert len(got[got.vec_id == 0]) == 32 and len(got[got.vec_id.isna()]) == 16


def test_whitening_of_few_and_huge_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [2.0, 4.0, 7.0]), (1, [2.0, 4.0, 7.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(few).collect()
    assert len(got) == 3 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12 and sorted(round(abs(r.whitened), 9) for r in got) == [1, 1, 1]
    assert whitening.whiten(few.limit(1)).count() == 0 and whitening.whiten(few.limit(0)).count() == 0
    huge = spark.createDataFrame([(i, [1e300 if i == 2 else float(i), -1e25 if i == 3 else 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r.vec_id for r in whitening.whiten(huge).collect()} == set(range(5))
    rows = [[float(i % 7) * 1e6, float(i % 5)] for i in range(35)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")).collect()}
    x = [[int(64 * c) for c in r] for r in rows]
    exact = [sum((35 * c - sum(r[k] for r in x)) ** 2 for k, c in enumerate(r)) for r in x]
    assert [got[i] for i in range(35)] == [t if t < 2**63 else None for t in exact] and None in got.values() and max(v for v in got.values() if v) > 2**62
