"""The pipeline stage by stage against brute force, on odd rows, empty tables and clashing names."""

import collections
import pathlib
import random

import pytest
from pyspark.sql import functions as F
from test_pairs import Union, brute, shingles

import corpus_pipeline
from leafmill.llm import mixing, toxicity

CLASHING = ("score", "n_hits", "copies", "copies_", "gone", "th", "th_", "row_", "line_keep", "kept_text", "k", "token", "item", "size", "y", "taken_id_")


def texts():
    rng = random.Random(3)
    sentence = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(12))
    lines = [sentence() for _ in range(40)]
    near = [x[:30] + "z" + x[31:] for x in lines[:12]]
    out = ["\n".join(rng.choices(lines + near, k=rng.choice([1, 3, 6]))) for _ in range(50)]
    out += [f"you {w} number {i} and more of it " * 3 for i, w in enumerate(["idiot", "1d10t", "idiot", "moron"] * 3)]
    unlike = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(6)]
    out += unlike + [unlike[0] + " tail", unlike[1]]
    return [*out, "", None, " \n ", out[0], "x" * 5000, "word " * 3000]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, "en", "s" if i % 3 else None, len(t or "")) for i, t in enumerate(texts())]
    rows += [rows[4], (None, "a null id of its own", "en", "t", 20), (7, "another text of row seven", "en", "s", 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit(c))
    return docs.cache()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, table):
    path = str(tmp_path_factory.mktemp("sf"))
    labels = [(i, int(1 if t and "you " in t else 0), 1) for i, t in enumerate(texts())] + [(None, 1, 1), (9999, 1, 0), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    table.write.parquet(f"{path}/documents.parquet")
    return path


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_every_stage_keeps_columns_and_takes_an_empty_table(spark, table, folder):
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, table, folder), stage(spark, table.limit(0), folder)
        if name != "bpe":
            assert out.columns == table.columns and [f.dataType for f in out.schema] == [f.dataType for f in table.schema], name
            assert rows(out, *CLASHING) == [CLASHING] * out.count(), name
        assert none.count() == 0, name


def test_toxic_documents_go(spark, table, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.fit(table, labels).score(table).where("score < 0.5")
    kept = corpus_pipeline.drop_toxic(spark, table, folder)
    assert rows(kept, "doc_id") == rows(scored, "doc_id")
    assert not any(t and t.startswith("you ") for _, t in rows(kept, "doc_id", "text")) and kept.where("text is null or text = ''").count() == 2


def test_lines_and_documents_that_repeat_go(spark, table, folder):
    kept = corpus_pipeline.drop_repeated_lines(spark, table, folder)
    hashed = {(r.doc_id, r.text): r.th for r in table.select("doc_id", "text", F.xxhash64("text").alias("th")).collect()}
    places = collections.Counter((i, t) for i, t in rows(table, "doc_id", "text"))
    order = sorted(places, key=lambda p: (p[0] is not None, p[0] or 0, hashed[p]))
    every = {x for _, t in order if t for x in t.split("\n") if x.strip()}
    windows = lambda x, n: {x[j : j + n] for j in range(max(1, len(x) - n + 1))}
    union = brute({x: windows(x, 5) for x in every})
    short = brute({x: windows(x, 3) for x in every if 24 <= len(x) <= 64})
    for x in list(short):
        union.join(x, short.top(x))
    seen, want = set(), []
    for i, t in order:
        left = []
        for x in (t or "").split("\n"):
            root = union.top(x) if x.strip() else None
            if root is None or root not in seen:
                left.append(x)
                seen |= {root} - {None}
        text = t if t is None else "\n".join(left)
        if text == t or text.strip():
            want += [(i, text)] * places[i, t]
    assert rows(kept, "doc_id", "text") == sorted(want, key=repr)
    assert all(n == len(t or "") for n, t in rows(kept.where("doc_id is not null and doc_id not in (4, 7)"), "n_chars", "text"))


def test_near_documents_leave_one_of_each_group(spark, table, folder):
    kept = corpus_pipeline.drop_near_duplicates(spark, table, folder)
    every = rows(table.where("doc_id is not null"), "doc_id", "text")
    sets = {(i, t): shingles(t) for i, t in every}
    union, links = Union(), brute(sets)
    for p in sets:
        union.join(("d", p[0]), ("p", *map(str, p)))
        union.join(("p", *map(str, p)), ("p", *map(str, links.top(p))))
    least: dict = {}
    for i, t in every:
        root = union.top(("d", i))
        least[root] = min(i, least.get(root, i))
    want = [(i, t) for i, t in every if least[union.top(("d", i))] == i] + rows(table.where("doc_id is null"), "doc_id", "text")
    assert rows(kept, "doc_id", "text") == sorted(want, key=repr)


def test_mix_takes_the_copies(spark, table, folder):
    taken = collections.Counter(rows(corpus_pipeline.mix(spark, table, folder), "doc_id"))
    copies = collections.Counter()
    for i, n in rows(mixing.mix_sources(table), "doc_id", "copies"):
        copies[(i,)] += n
    assert taken == +copies


def test_the_whole_run(spark, folder):
    out = corpus_pipeline.run(spark, folder).toPandas()
    assert len(out) > 20 and {"doc_id", "n_tokens", "ids"} <= set(out.columns)
    assert (out["ids"].map(len) == out["n_tokens"]).all()


def test_the_whole_run_leaves_only_the_last_stages_table(spark, folder):
    shared = pathlib.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    before = {p.parent for p in shared.rglob("*.parquet")}
    out = corpus_pipeline.run(spark, folder)
    left = {p.parent for p in shared.rglob("*.parquet")} - before
    assert len(left) == 1 and out.count() == spark.read.parquet(str(*left)).count()
