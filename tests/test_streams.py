"""Streams that stop and go on, state that goes, items that come late, writers that meet, and data inside of pages."""

import datetime as dt
import os
import random
import threading

from pyspark.sql import functions as F

from leafmill.operators import embedded, extract, library, store
from leafmill.sources import files, versions
from leafmill.streaming import idle, pending, progress, throttle


def at(ms):
    return dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)


def land(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_state_of_idle_books_goes(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, idle.PROVIDER)
    source, hour = str(tmp_path / "in"), 3_600_000
    steps = [
        ([(1, 1, 5, at(0), "tick"), (2, 2, 5, at(100), "tick"), (3, 3, 5, at(200), "tick")], [1, 2, 3]),
        ([(1, 4, 5, at(hour), "tick"), (3, 5, 0, at(hour), "deleted"), (3, 6, 5, at(hour + 1), "tick")], [6]),  # the same line is not kept, but counts as seen
        ([(4, 7, 1, at(9 * hour), "tick")], [7]),  # moves the watermark past the idle time of all others
        ([(2, 8, 5, at(9 * hour + 1), "tick"), (4, 9, 1, at(9 * hour + 2), "tick")], [8]),  # book 2 is new again
    ]
    want = []
    for rows, kept in steps:
        want += kept
        land(spark, rows, throttle.OUT, source)
        stream = idle.stream_throttle_idle(spark.readStream.schema(throttle.OUT).parquet(source), 10, 2 * hour, "1 minute")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(r.item_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
        left = q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    few = left
    spark.conf.set(key, before)
    assert few <= 2 * 2  # books 2 and 4, each with a value and a timer; books 1 and 3 have left


FEED = "kind string, fp string, item_id long, text string"


def test_late_items_are_filled_once(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    items = lambda rows: pending.items_feed(spark.createDataFrame(rows, "item_id long, url string, content_text string"))
    texts = lambda rows: pending.extracts_feed(spark.createDataFrame(rows, "url string, text string"))

    def run(rows):
        rows.coalesce(1).write.mode("append").parquet(source)
        pending.stream_late_backfill(spark.readStream.schema(FEED).parquet(source), target, check).awaitTermination()
        return sorted(map(tuple, pending.filled(spark, target).collect()))

    assert run(texts([("https://a/1?utm_x=1", " one "), ("https://a/2", " "), ("https://a/3", "three")])) == []
    assert run(items([(1, "https://a/1", None), (2, "https://a/2", ""), (9, "https://a/3", "old")])) == [(1, "one")]
    assert run(texts([("https://a/2", "two"), ("https://a/1", "other")])) == [(1, "one"), (2, "two")]
    assert run(items([(3, "https://a/1", " "), (1, "https://a/1", "")])) == [(1, "one"), (1, "one"), (2, "two"), (3, "one")]  # an item that comes anew is filled anew
    done = sorted(os.listdir(tmp_path / "check/commits"))
    last = [n for n in done if n.isdigit()][-1]
    for n in (last, f".{last}.crc"):  # as after a crash before the last batch was noted as done
        if os.path.exists(tmp_path / "check/commits" / n):
            os.remove(tmp_path / "check/commits" / n)
    pending.stream_late_backfill(spark.readStream.schema(FEED).parquet(source), target, check).awaitTermination()
    assert len(pending.filled(spark, target).collect()) == 4


def test_snapshots_that_are_not_finished_do_not_count(spark, tmp_path):
    schema, source, target = "book_id long, item_id long, line_index int, updated_at timestamp", str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, [(1, 1, 1, at(0))], schema, source)
    progress.stream_progress(spark.readStream.schema(schema).parquet(source), target, str(tmp_path / "check")).awaitTermination()
    land(spark, [(1, 99, 9, at(5))], schema, f"{target}/batch=7")
    os.remove(f"{target}/batch=7/_SUCCESS")
    assert [r.item_id for r in progress.snapshot(spark, target).collect()] == [1]


def test_two_writers_lose_no_rows(spark, tmp_path):
    target = str(tmp_path / "library")
    books = spark.createDataFrame([(1, "url")], "id long, source_type string")
    empty = spark.createDataFrame([], "book_id long, item_id long, order_index long")
    store.publish({"items": empty}, target)
    failed = []

    def append(first):
        def change(lib, version):
            old = lib.table("items", version)
            new = spark.createDataFrame([(1, first + i) for i in range(3)], "book_id long, item_id long")
            return {"items": old.unionByName(library.append_items(old, new, books).drop("error"))}

        try:
            versions.Library(spark, target).commit(change)
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    writers = [threading.Thread(target=append, args=(10 * k,)) for k in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    got = sorted((r.order_index, r.item_id) for r in store.published(spark, target, "items").collect())
    assert not failed and [i for i, _ in got] == list(range(9)) and sorted(x for _, x in got) == [0, 1, 2, 10, 11, 12, 20, 21, 22]


def test_versions_that_are_held_or_new_stay(spark, tmp_path):
    lib = versions.Library(spark, str(tmp_path / "library"))
    assert lib.head() == (0, None) and lib.table("t") is None and lib.clean() == []
    one = lib.publish({"t": spark.range(1)})
    with lib.held() as version:
        assert version == one
        for n in range(2, 5):
            lib.publish({"t": spark.range(n)})
        crashed = lib._written({"t": spark.range(9)})  # never becomes good
        assert lib.table("t").count() == 4 and lib.clean() == [2] and lib.table("t", one).count() == 1
    assert lib.clean() == [one] and lib.clean(unfinished_ms=0) == [crashed] and lib.head() == (4, 4)
    lib._put("good/5", "4")  # another writer is always first
    state = lib.head

    def beaten():
        s, v = state()
        lib._put(f"good/{s + 1}", str(v))
        return s, v

    lib.head = beaten
    try:
        lib.commit(lambda l, v: {"t": spark.range(1)})
        raise AssertionError("a lost race became good")
    except versions.Conflict:
        pass


def one(spark, column):
    return spark.range(1).select(column.alias("r")).first()["r"]


def test_json_that_is_walked(spark):
    walk = lambda t: one(spark, extract.walk_json(F.lit(t)))
    assert walk('{"x":{"text":"inner"},"name":"n","articleBody":"b","text":["no"]}') == ['"b"', '"n"', '"inner"']
    assert walk('[{"text":"1","a":[{"text":"2"},"s",{"a":{"text":"3"}}]},{"headline":"4"}]') == ['"1"', '"2"', '"3"', '"4"']
    assert walk('"text"') == walk("") == walk("null") == walk("[]") == [] and walk('{"text":"a\\\\","name":"\\"q\\""}') == ['"a\\\\"', '"\\"q\\""']
    long = '{"articleBody":"' + "words, and \\n more; " * 50_000 + '"}'
    assert len(one(spark, extract.structured_text(F.lit(f'<script type="application/ld+json">{long}</script>')))) > 800_000


def test_brackets_in_lists(spark):
    lists = ['[{"title":"a b","tags":[]},{"title":"c ] d","x":[[1],["]"]]}]', '[{"title":"a b","x":[1}', "[]", '[{"title":"a\\"]b"}] ]']
    pages = spark.createDataFrame([(i, "u", f'{{"chapterInfos":{x}, "y":[1]}}') for i, x in enumerate(lists)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.title) for r in embedded.inline_chapters(pages).collect()) == [(0, "a b"), (0, "c ] d"), (3, 'a"]b')]


def test_pages_of_too_many_elements(spark):
    body = "<article><p>" + "A long sentence of the text of this page. " * 20 + "</p></article>"
    pages = spark.createDataFrame([(1, "https://a.com/1", f"<body>{body}</body>"), (2, "https://a.com/2", f"<body>{body}" + "<i></i>" * 5000 + "<script>'<b>'</script></body>")], "page_id long, url string, html string")
    got = {r.page_id: (r.status, r.content) for r in extract.extract_pages(pages).collect()}
    assert got[1][0] == "OK" and got[2] == ("DOM_TOO_LARGE", None)
    assert [r.n for r in pages.orderBy("page_id").select(extract.element_count(F.col("html")).alias("n")).collect()] == [2, 5003]


def test_charset_repair_by_chunks(spark, monkeypatch):
    """Characters that a chunk cuts in two, signs of a byte order, and bytes that are no text."""
    monkeypatch.setattr(files, "CHUNK", 5)
    text = "第一章春天来了万物复苏" * 9
    rows = [("utf8", text.encode()), ("bom", b"\xef\xbb\xbf" + text.encode()), ("gb", text.encode("gb18030")), ("twice", text.encode("gbk").decode("latin1").encode()), ("bad", b"\xff\xfe\x81" * 7), ("empty", b""), ("null", None)]
    got = {r.path: r for r in files.repair_charset(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert all(got[k].text == text for k in ("utf8", "bom", "gb", "twice")) and got["empty"].text == got["null"].text == ""
    assert [got[k].changed for k in ("utf8", "bom", "gb", "twice", "empty")] == [False, False, True, True, False] and got["twice"].method.startswith("utf8->view")
    for _, b in rows:
        for method, codec, is_view in files._methods(True):
            plain = (b or b"").decode("utf-8-sig", "replace")
            whole = plain.encode("latin1", "replace").decode(codec, "replace") if is_view else plain if codec == "utf-8" else (b or b"").decode(codec, "replace")
            assert "".join(files._pieces(b or b"", codec, is_view)) == whole, (b, method)


def test_throttled_table_against_a_walk(spark):
    """Bursts, jumps, flushes, deletions and equal times; one book has most of the rows."""
    rng = random.Random(12)
    rows, ms, line = [], {b: 0 for b in range(4)}, {b: 0 for b in range(4)}
    for i in range(900):
        b = 0 if rng.random() < 0.7 else rng.randrange(4)
        ms[b] += rng.choice((0, 1, 40, 300, 900, 1500, 1501, 4000))
        line[b] += rng.choice((0, 0, 0, 1, -1, 30, 61, -70))
        rows.append((b, i, line[b], at(ms[b]), rng.choices(("tick", "pause", "unmount", "deleted", None), (80, 3, 3, 4, 10))[0]))
    rows += [(None, 1, 1, at(0), "tick"), (1, 2, 3, None, "tick")]
    want = []
    for b in range(4):
        state = None
        for _, i, l, t, why in sorted((r for r in rows if r[0] == b and r[3]), key=lambda r: (r[3], r[1])):
            now = round((t - at(0)).total_seconds() * 1000)
            ok = why != throttle.DELETED and throttle.passes(now, l, why, state, 10)
            state = None if why == throttle.DELETED else (now, l) if ok else state
            want += [i] * ok
    table = spark.createDataFrame(rows, throttle.OUT)
    assert sorted(r.item_id for r in throttle.throttle(table, 10).collect()) == sorted(want)
    assert throttle.throttle(table.limit(0), 10).count() == 0
    plan = throttle.throttle(table, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
