"""Trees of groups: ancestors, sizes and places by pointer doubling, which give interval labels.

A round doubles how far each row looks, so trees of depth d take about log2(d)
rounds, however many groups they have. Each round's table is written. No limit
of depth or rows is set, and no task gathers the groups below one parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.storage import Rounds, few, settle

FEW_ROOTS = 1_000
INDENT = 6
HOT, HOT_ROWS = 64, 10_000
"""A key with more than one HOT-th of the rows, and more than HOT_ROWS, is met in HOT places."""


def numbered(groups: DataFrame) -> DataFrame:
    """(no, id, parent, rooted, order_index, title) of groups(id, parent_id, order_index, title): numbers in place of ids; parent is null for a root and for one whose parent is not there, which is not rooted."""
    nodes = settle(groups.where("id is not null").select(F.monotonically_increasing_id().alias("no"), "id", "parent_id", "order_index", "title"))
    above = nodes.select(F.col("id").alias("parent_id"), F.col("no").alias("parent"))
    return settle(nodes.join(above, "parent_id", "left").select("no", "id", "parent", F.col("parent_id").isNull().alias("rooted"), "order_index", "title"))


def _segment(nodes: DataFrame):
    return F.concat(F.lpad(F.col("order_index").cast("string"), 6, "0"), F.lit(" "), "title")


def _meet(rows: DataFrame, far: DataFrame, key: str, n: int, counted: DataFrame | None = None) -> DataFrame:
    """rows(no, key, ...), n of a tree table, with the columns of far, of which a key has one row at most; null where it has none.

    A key with over one HOT-th of n rows, of which there are fewer than HOT,
    is met in HOT places if it has over HOT_ROWS; rows without a key are spread. `counted` has the
    keys of rows, if that is a table which is cheaper to read.
    """
    met = (rows if counted is None else counted).where(f"{key} is not null").groupBy(key).count().where((F.col("count") * HOT > n) & (F.col("count") > HOT_ROWS))
    found = [r[0] for r in met.collect()]
    hot = F.col(key).isin(found) if found else F.lit(False)
    salt = F.when(F.col(key).isNull(), F.col("no")).when(hot, F.pmod(F.xxhash64("no"), F.lit(HOT))).otherwise(F.lit(0)).cast("long")
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(HOT - 1))).otherwise(F.array(F.lit(0))).cast("array<long>")
    far = far.withColumn("salt_", F.explode(copies))
    return rows.withColumn("salt_", salt).join(far, [key, "salt_"], "left").drop("salt_")


def tops(nodes: DataFrame, places: bool = False) -> DataFrame:
    """(no, top, depth, done) by pointer doubling; done is false for groups on a cycle or below one. `places` adds the path of (order, title) from the top."""
    place = _segment(nodes) if places else F.lit("")
    rounds = Rounds(nodes.select("no", F.coalesce("parent", "no").alias("top"), F.col("parent").isNotNull().cast("long").alias("depth"), F.col("parent").isNull().alias("done"), place.alias("place")))
    held = rounds.df
    n = held.count()
    for _ in range(n.bit_length() + 1):
        if held.where("not done").isEmpty():
            break
        far = held.select(F.col("no").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"), F.col("done").alias("ends"), F.col("place").alias("before"))
        longer = F.concat("before", F.lit("/"), "place") if places else F.lit("")
        moved = _meet(held.where("not done"), far, "top", n).select("no", F.col("next").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("done"), longer.alias("place"))
        held = rounds.put(held.where("done").unionByName(moved))
    return held if places else held.drop("place")


def _sizes(inside: DataFrame, n: int) -> DataFrame:
    """(no, size) of the groups of trees: how many are at or below each.

    What is less than 2**k steps below a group is known in round k; those just
    2**k below it bring what is less than 2**k below them.
    """
    rounds = Rounds(inside.select("no", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size")))
    held = rounds.df
    while not held.where("up is not null").isEmpty():
        more = held.where("up is not null").groupBy("up").agg(F.sum("size").alias("more")).withColumnRenamed("up", "no")
        grown = held.join(more, "no", "left").select("no", "up", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        held = rounds.put(_meet(grown, held.select(F.col("no").alias("up"), F.col("up").alias("next")), "up", n, held).select("no", F.col("next").alias("up"), "size"))
    return held.select("no", "size")


def _steps(inside: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """(no, up, at): how far behind its parent a group comes, depth first; 0 and no parent for a root.

    Siblings are by order, title and number. They are sorted over ranges, not
    gathered by parent: sums run on from range to range, and a parent's first
    child tells where its own begin.
    """
    keys = ["parent", "order_index", "title", "no"]
    parts = int(inside.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    below = inside.where("parent is not null").join(sizes, "no").repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = settle(below.select("no", "parent", "size", F.monotonically_increasing_id().alias("seq"), F.spark_partition_id().alias("part")))
    before = lambda size, w: F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("part").agg(F.sum("size").alias("whole")).select("part", before("whole", Window.orderBy("part")).alias("start"))  # as many rows as partitions
    ran = placed.withColumn("ran", before("size", Window.partitionBy("part").orderBy("seq"))).join(F.broadcast(starts), "part").select("no", "parent", (F.col("start") + F.col("ran")).alias("ran"))
    first = ran.groupBy("parent").agg(F.min("ran").alias("first"))
    steps = _meet(ran, first, "parent", n, placed).select("no", F.col("parent").alias("up"), (F.col("ran") - F.col("first") + 1).alias("at"))
    return steps.unionByName(inside.where("parent is null").select("no", F.col("parent").alias("up"), F.lit(0).cast("long").alias("at")))


def interval_labels(nodes: DataFrame, held: DataFrame) -> DataFrame:
    """(no, top, depth, enter, leave) of the groups of trees: a group's place in its tree, depth first, and that of the last group below it.

    A group comes behind its parent by one and all that is at or below its
    earlier siblings; its place is the sum of this on the way up to its root.
    Sizes and sums both come from pointer doubling, log2(depth) rounds each.
    """
    trees = held.where("done").select("no", "top", "depth")
    inside = settle(nodes.join(trees, "no", "left_semi").select("no", "parent", "order_index", "title"))
    n = inside.count()
    sizes = _sizes(inside, n)
    rounds = Rounds(_steps(inside, sizes, n))
    way = rounds.df
    while not way.where("up is not null").isEmpty():
        far = way.select(F.col("no").alias("up"), F.col("up").alias("next"), F.col("at").alias("more"))
        way = rounds.put(_meet(way, far, "up", n).select("no", F.col("next").alias("up"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at")))
    return trees.join(way.select("no", F.col("at").alias("enter")), "no").join(sizes, "no").select("no", "top", "depth", "enter", (F.col("enter") + F.col("size") - 1).alias("leave"))


def _pairs(nodes: DataFrame, up: DataFrame, on_cycles: bool) -> DataFrame:
    """(no, above, depth): each group with all above it and itself, looking twice as far in each round. On cycles, each above once, at the least depth."""
    pairs = settle(nodes.select("no", F.col("no").alias("above"), F.lit(0).cast("long").alias("depth")))
    jump, far, before = settle(up), 1, -1
    while not jump.isEmpty():
        longer = jump.join(pairs.withColumnRenamed("no", "to"), "to").select("no", "above", (F.col("depth") + far).alias("depth"))
        pairs = pairs.unionByName(longer)
        if on_cycles:
            pairs = pairs.groupBy("no", "above").agg(F.min("depth").alias("depth"))
        pairs = settle(pairs)
        if on_cycles and before == (before := pairs.count()):
            break
        jump = settle(jump.join(jump.select(F.col("no").alias("to"), F.col("to").alias("next")), "to").select("no", F.col("next").alias("to")))
        far *= 2
    return pairs


def group_closure(groups: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """H1: (root, id, depth) of every group at or below each of roots(id), or below each group.

    Groups that are on a cycle or below one are reached once each. With up to
    FEW_ROOTS roots, what is below them is a range of the tree's labels; else
    all pairs are made, which are as many as the result has without roots.
    """
    nodes = numbered(groups)
    held = tops(nodes)
    ids = nodes.select("no", "id")
    start = None if roots is None else settle(roots.select("id").distinct().join(ids, "id").select("no", F.col("id").alias("root")))
    loose = nodes.join(held.where("not done"), "no", "left_semi")
    up = lambda part: part.where("parent is not null").select("no", F.col("parent").alias("to"))
    pairs = _pairs(loose, up(loose), True) if not loose.isEmpty() else None
    if start is not None and few(start, FEW_ROOTS):
        labels = settle(interval_labels(nodes, held))
        heads = start.join(labels, "no").select("root", "top", F.col("enter").alias("enter_"), "leave", F.col("depth").alias("depth_"))
        below = labels.drop("leave").join(F.broadcast(heads), "top").where("enter between enter_ and leave")
        found = below.join(ids, "no").select("root", "id", (F.col("depth") - F.col("depth_")).alias("depth"))
    else:
        tree = nodes.join(held.where("done"), "no", "left_semi")
        all_pairs = _pairs(tree, up(tree), False)
        pairs = all_pairs if pairs is None else pairs.unionByName(all_pairs)
        found = None
    if pairs is not None:
        heads = (ids.withColumnRenamed("id", "root") if start is None else start).withColumnRenamed("no", "above")
        named = pairs.join(heads, "above").join(ids, "no").select("root", "id", "depth")
        found = named if found is None else found.unionByName(named)
    return found.withColumn("depth", F.col("depth").cast("int"))


def _label(depth: str):
    return F.concat(F.expr(f"repeat('  ', int(least({depth}, {INDENT})))"), "title").alias("label")


def group_tree(groups: DataFrame) -> DataFrame:
    """H2: (id, label, place) depth first; siblings by order and title; labels indented up to six levels. Groups on a cycle, or with a parent that is not there, have no root and so no place."""
    nodes = numbered(groups)
    held = tops(nodes, places=True)
    rooted = nodes.where("rooted").select(F.col("no").alias("top"))
    return held.where("done").join(rooted, "top", "left_semi").join(nodes.select("no", "id", "title"), "no").select("id", _label("depth"), "place")


def tree_order(groups: DataFrame) -> DataFrame:
    """H2: (id, label, root, depth, enter, leave): the tree depth first by numbers, so that what is below a group are those of its root with enter between its two; siblings by order and title. Groups without a root are left out."""
    nodes = numbered(groups)
    labels = interval_labels(nodes, tops(nodes))
    rooted = nodes.where("rooted").select(F.col("no").alias("top"), F.col("id").alias("root"))
    return labels.join(rooted, "top").join(nodes.select("no", "id", "title"), "no").select("id", _label("depth"), "root", F.col("depth").cast("int").alias("depth"), "enter", "leave")
