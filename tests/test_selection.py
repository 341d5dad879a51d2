"""Nesting of pages, exact percentiles and trees of groups against plain Python."""

import math
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from leafmill.operators import contents, extract, nesting, percentiles, quality, trees

PAGE = "page_id long, url string, html string"


def plain_nesting(source):
    """(levels, blocks) of a page by a Python stack."""
    stack, levels, blocks = [], [], []
    for i, token in enumerate(re.findall("<[^>]+>|[^<]+", source)):
        m = re.match(r"<(/?)([a-zA-Z0-9]+)", token)
        if not m or m[2] not in nesting.CONTAINERS:
            levels.append(None)
        elif not m[1]:
            stack.append((i, m[2]))
            levels.append(len(stack))
        else:
            levels.append(len(stack))
            if stack:
                start, tag = stack.pop()
                blocks.append((start, i, tag))
    return levels, sorted(blocks + [(s, None, t) for s, t in stack], key=lambda b: b[0])


def test_fold_against_a_stack(spark):
    rng = random.Random(4)
    parts = ["<div>", "</div>", "<ul>", "</ul>", "<p>", "text. ", "<a href='/x'>", "</a>", "<table>", "</table>", "<nav>", "</nav>", "<br>"]
    sources = ["".join(rng.choice(parts) for _ in range(n)) for n in [0, 1, 2, 5, 15, 16, 17, 60, 300, 900] * 3] + [None]
    pages = spark.createDataFrame([(7, f"https://a.com/{i}", s) for i, s in enumerate(sources)], PAGE)  # rows that share an id stay apart
    for r in nesting.nested(pages, "url").collect():
        levels, blocks = plain_nesting(sources[int(r.url.split("/")[-1])] or "")
        assert [s.level for s in r.states] == levels
        assert [(b.start, b.end, b.tag) for b in r.blocks] == blocks
        linked = [x for x in r.links]
        for b in r.blocks:  # a block's links are a range of their numbers
            assert [x.at for x in linked[b.first : b.first + b.n]] == [x.at for x in linked if x.at > b.start and (b.end is None or x.at < b.end)]


def test_long_page_of_nested_blocks(spark):
    deep = "<div>" * 300 + "".join(f"<li><a href='/c/12345-{i}'>Chapter {i}</a></li>" for i in range(5000)) + "</div>" * 300
    pages = spark.createDataFrame([(1, "https://a.com/x", f"<ol>{deep}</ol>"), (2, "https://a.com/y", "<ul>" + "<li><ul>" * 50)], PAGE)
    (r,) = contents.best_lists(pages).collect()
    assert (r.tag, r.quality) == ("ol", 6 * 5000)
    assert contents.page_contents(pages).count() == 5000 and extract.best_text(pages).count() == 0


def test_percentiles_against_sorting(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "FEW", 40)
    monkeypatch.setattr(percentiles, "GRID", 20)
    rng = np.random.default_rng(0)
    parts = {"normal": rng.standard_normal(3000), "two": np.r_[np.zeros(1500), np.ones(1500)], "one": np.full(900, 7.0), "steep": 2.0 ** np.arange(-1000, 1000), "few": rng.random(9), None: rng.integers(0, 50, 900).astype(float)}
    rows = [(k, float(v)) for k, x in parts.items() for v in x] + [("few", None), ("few", float("nan")), ("none", None)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "v"]).astype(object).where(lambda x: x.notna(), None).values.tolist(), "k string, v double")
    shares = (0.0, 0.01, 0.5, 0.9, 0.999, 1.0)
    got = {r.k: list(r[1:]) for r in percentiles.exact_percentiles(df, "k", "v", shares).collect()}
    assert got == {k: [np.sort(x)[max(1, math.ceil(s * len(x))) - 1] for s in shares] for k, x in parts.items()}
    assert percentiles.exact_percentiles(df.limit(0), "k", "v", shares).count() == 0


def test_percentiles_of_one_key_with_all_rows(spark):
    rows = spark.range(300_000).select(F.lit("k").alias("key"), ((F.col("id") * 7919) % 100_003).cast("double").alias("value"))
    (r,) = quality.perf_summary(rows, "key", "value").collect()
    values = np.sort([(i * 7919) % 100_003 for i in range(300_000)])
    values = values[values > 0]
    assert (r.n, r.p50, r.p90) == (len(values), *[values[math.ceil(q * len(values)) - 1] for q in (0.5, 0.9)])


GROUPS = "id string, parent_id string, order_index long, title string"


def test_trees_with_cycles_and_orphans(spark):
    rows = [("a", None, 1, "A"), ("b", "a", 2, "B"), ("c", "a", 1, "C"), ("d", "b", 0, "D"), ("e", "x", 0, "E"), ("f", "e", 0, "F"), ("p", "q", 0, "P"), ("q", "p", 0, "Q"), ("r", "p", 0, "R"), ("s", None, 0, "S"), ("t", "t", 0, "T")]
    groups = spark.createDataFrame(rows, GROUPS)
    below = {"a": "a0 b1 c1 d2", "b": "b0 d1", "c": "c0", "d": "d0", "e": "e0 f1", "f": "f0", "p": "p0 q1 r1", "q": "q0 p1 r2", "r": "r0", "s": "s0", "t": "t0"}
    want = sorted((k, x[0], int(x[1])) for k, v in below.items() for x in v.split())
    assert sorted(map(tuple, trees.group_closure(groups).collect())) == want
    some = trees.group_closure(groups, groups.where("id in ('a', 'q', 'e')"))
    assert sorted(map(tuple, some.collect())) == [w for w in want if w[0] in "aqe"]
    order = sorted((tuple(r) for r in trees.tree_order(groups).collect()), key=lambda r: (r[2], r[4]))
    assert order == [("a", "A", "a", 0, 0, 3), ("c", "  C", "a", 1, 1, 1), ("b", "  B", "a", 1, 2, 3), ("d", "    D", "a", 2, 3, 3), ("s", "S", "s", 0, 0, 0)]
    assert sorted(r.id for r in trees.group_tree(groups).collect()) == ["a", "b", "c", "d", "s"]
    assert trees.tree_order(groups.limit(0)).count() == 0 and trees.group_closure(groups.limit(0)).count() == 0


def test_deep_chain_and_wide_parent(spark, monkeypatch):
    monkeypatch.setattr(trees, "HOT_ROWS", 1000)  # w0 is met in several places
    chain = spark.range(5000).select(F.concat(F.lit("c"), "id").alias("id"), F.when(F.col("id") > 0, F.concat(F.lit("c"), F.col("id") - 1)).alias("parent_id"), F.col("id").alias("order_index"), F.lit("x").alias("title"))
    wide = spark.range(3000).select(F.concat(F.lit("w"), "id").alias("id"), F.when(F.col("id") > 0, "w0").alias("parent_id"), (-F.col("id")).alias("order_index"), F.lit("y").alias("title"))
    groups = chain.unionByName(wide)
    r = {x.id: x for x in trees.tree_order(groups).where("id in ('c0', 'c4999', 'w0', 'w2999', 'w1')").collect()}
    assert (r["c0"].enter, r["c0"].leave, r["c4999"].enter, r["c4999"].depth) == (0, 4999, 4999, 4999)
    assert (r["w0"].leave, r["w2999"].enter, r["w1"].enter) == (2999, 1, 2999)
    assert trees.group_closure(groups, groups.where("id = 'c10'")).count() == 4990
