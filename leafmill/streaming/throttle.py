"""Which rows of a progress feed are worth keeping: a state of two numbers a book, as a stream or over a table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.nesting import fold
from ..operators.store import backfill
from ..sources.storage import settle

# The least milliseconds between kept rows, the screens that count as a jump, and reasons that always pass.
INTERVAL_MS = 1500
JUMP_SCREENS = 6
FLUSH = ("pause", "unmount")
DELETED = "deleted"
OUT = "book_id long, item_id long, line_index int, updated_at timestamp, reason string"
STATE = "last_ms long, last_line int"


def passes(ms: int, line: int, reason: str | None, state: tuple[int, int] | None, rows: int) -> bool:
    """The first row, a flush, and another line after the interval or a jump."""
    if state is None or reason in FLUSH:
        return True
    return line != state[1] and (ms - state[0] >= INTERVAL_MS or abs(line - state[1]) >= max(1, JUMP_SCREENS * rows))


def _prepared(feed: DataFrame) -> DataFrame:
    """Rows without a book or time are left out; a null line is 0."""
    kept = feed.where("book_id is not null and updated_at is not null")
    return kept.select("book_id", "item_id", F.coalesce("line_index", F.lit(0)).cast("int").alias("line_index"), F.col("updated_at").cast("timestamp").alias("updated_at"), "reason", F.unix_millis(F.col("updated_at").cast("timestamp")).alias("ms"))


BLOCK = 1 << 14
"""Rows that are walked through as one."""
_ROW = "struct<seq:bigint,book_id:bigint,item_id:bigint,line_index:int,updated_at:timestamp,reason:string,ms:bigint>"
_END = ("book", "held", "ms", "line", "told")
_BEFORE = "block long, book long, held boolean, ms long, line int"


def _walked(blocks: DataFrame, rows: int) -> DataFrame:
    """(block, what it ends with, kept): the rows of each block that pass, from the state (book, held, ms, line) that it begins with.

    told: whether a row of the block, the first of a book, a flush or a
    deletion, sets the state whatever it was, so the end does not hang on it.
    """
    fields = (*_END, "kept")

    def step(acc: Column, x: Column) -> Column:
        new = ~acc["book"].eqNullSafe(x["book_id"])
        gone, flush = F.coalesce(x["reason"] == DELETED, F.lit(False)), F.coalesce(x["reason"].isin(*FLUSH), F.lit(False))
        away = (x["ms"] - acc["ms"] >= INTERVAL_MS) | (F.abs(x["line_index"] - acc["line"]) >= max(1, JUMP_SCREENS * rows))
        ok = ~gone & (new | ~acc["held"] | flush | ((x["line_index"] != acc["line"]) & away))
        put = lambda ok: F.struct(
            x["book_id"].alias("book"), (~gone).alias("held"), F.when(ok, x["ms"]).otherwise(acc["ms"]).alias("ms"), F.when(ok, x["line_index"]).otherwise(acc["line"]).alias("line"),
            (acc["told"] | new | gone | flush).alias("told"), F.when(ok, F.array_append(acc["kept"], x)).otherwise(acc["kept"]).alias("kept"),
        )
        return F.get(F.transform(F.array(ok), put), F.lit(0))

    zero = F.struct("book", F.coalesce("held", F.lit(False)).alias("held"), "ms", "line", F.lit(False).alias("told"), F.array().cast(f"array<{_ROW}>").alias("kept"))
    # inline: as a struct the fold would be worked out anew for each of its fields that is read
    return blocks.select("block", F.inline(F.array(fold(F.col("rows"), zero, step, fields, ("kept",)))))


def throttle(feed: DataFrame, rows: int) -> DataFrame:
    """G2 over a table: (book_id, item_id, line_index, updated_at, reason) of the rows that pass, by time and item.

    Rows are sorted over ranges and cut into blocks, so a book's rows may lie in
    many of them. What a block ends with is known from its own rows as soon as
    a book begins in it, or a row is a flush or a deletion. Only blocks without
    such a row hang on what came before: those that began with another state
    than the one before them ends with are walked again, all at once, until
    there are none: once or twice as a rule, as chains meet soon, and a time a
    block for a book without flushes whose chains never meet. The driver sees
    one row a block.
    """
    p = _prepared(feed)
    spark, order = p.sparkSession, ["book_id", "updated_at", "item_id", "line_index", "reason"]
    k = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(p.repartitionByRange(k, *order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id()))
    row = F.struct(*[f.split(":")[0] for f in _ROW[7:-1].split(",")])
    blocks = settle(dealt.groupBy(F.floor(F.col("seq") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(row)).alias("rows")))
    before: dict = {}
    begun = lambda chosen: blocks.join(F.broadcast(spark.createDataFrame([(b, *before.get(b, (None, False, None, None))) for b in chosen], _BEFORE)), "block")
    guess = {"book": F.col("rows")[0]["book_id"], "held": F.lit(False), "ms": F.lit(None).cast("long"), "line": F.lit(None).cast("int")}  # that the block goes on with its first row's book
    ends = {b: e for b, *e in _walked(blocks.withColumns(guess), rows).select("block", *_END).collect()}
    numbers = sorted(ends)
    while True:
        known = {b: tuple(ends[a][:4]) for a, b in zip(numbers, numbers[1:])}
        wrong = [b for b in known if not ends[b][4] and known[b] != before.get(b)]
        before = known
        if not wrong:
            break
        ends |= {b: e for b, *e in _walked(begun(wrong), rows).select("block", *_END).collect()}
    return _walked(begun(numbers), rows).select(F.inline("kept")).select("book_id", "item_id", "line_index", "updated_at", "reason")


def stream_throttle(feed: DataFrame, rows: int) -> DataFrame:
    """G2, G5 as a stream: the rows that pass, in order of time within a batch; a row of reason `deleted` clears its book's state and is not passed on."""

    def update(key, parts, state):
        held = state.get if state.exists else None
        pdf = pd.concat(list(parts)).sort_values(["updated_at", "item_id"], kind="stable")
        keep = []
        for ms, line, reason in zip(pdf["ms"], pdf["line_index"], pdf["reason"]):
            ok = reason != DELETED and passes(ms, line, reason, held, rows)
            held = None if reason == DELETED else (int(ms), int(line)) if ok else held
            keep.append(ok)
        if held is not None:
            state.update(held)
        elif state.exists:
            state.remove()
        yield pdf.loc[keep, ["book_id", "item_id", "line_index", "updated_at", "reason"]]

    return _prepared(feed).groupBy("book_id").applyInPandasWithState(update, OUT, STATE, "append", "NoTimeout")


def stream_backfill(extracts: DataFrame, items: str, target: str, checkpoint: str):
    """Starts a query that writes, for each micro-batch, the empty items that it fills, under target/batch=n.

    Items are the table at `items`; a batch that is run again writes the same
    rows in the same place. Of several texts for an item the least batch counts.
    """
    def fill(batch: DataFrame, n: int) -> None:
        empty = batch.sparkSession.read.parquet(items).where("trim(coalesce(content_text, '')) = ''")
        backfill(empty, batch.select("url", "text")).where("trim(coalesce(content_text, '')) <> ''").write.mode("overwrite").parquet(f"{target}/batch={n}")

    return extracts.writeStream.foreachBatch(fill).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
