"""Interval and caption curation: splitting, bucketing, ordered folds, joins of intervals, lookups, resumption."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of an Arrow batch of prompts: a worker holds some copies of one.
BATCH_BYTES = 4 << 20


def split_even(df: DataFrame, length: str, parts: int) -> DataFrame:
    """``parts`` equal (start, end) ranges of 0..length; the last ends one second early."""
    size = F.col(length) / parts
    out = df.where(F.col(length) > 0).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return out.withColumn("start", F.col("part") * size).withColumn("end", F.when(F.col("part") == parts - 1, F.col(length) - 1).otherwise((F.col("part") + 1) * size))


def split_windows(df: DataFrame, start: str, end: str, width: int = 10) -> DataFrame:
    """Segments longer than ``width`` as windows of that width from their start; the last window may overrun."""
    long = F.col(end) - F.col(start) > width
    steps = F.sequence(F.lit(0), F.greatest(F.floor(F.col(end) - F.col(start)).cast("int") - 1, F.lit(0)), F.lit(width))
    one = df.withColumn("_o", F.explode(F.when(long, steps).otherwise(F.array(F.lit(0)))))
    begin = F.col(start) + F.col("_o")
    return one.withColumn(end, F.when(long, begin + width).otherwise(F.col(end))).withColumn(start, begin).drop("_o")


def adaptive_size(n: Column, base: int = 8) -> Column:
    """Captions in a group: all of fewer than 8, four of up to 16, else the base."""
    return F.when(n < 8, n).when(n <= 16, 4).otherwise(base)


def group_captions(df: DataFrame, key: str, order: list[str], size: Column | int | None = None) -> DataFrame:
    """Number of each caption's group of consecutive captions of its video."""
    w = Window.partitionBy(key)
    n = F.count("*").over(w)
    per = adaptive_size(n) if size is None else (F.lit(size) if isinstance(size, int) else size)
    return df.withColumn("group_id", F.floor((F.row_number().over(w.orderBy(*order)) - 1) / per).cast("long"))


def merge_groups(df: DataFrame, keys: list[str], order: list[str], text: str, start: str, end: str) -> DataFrame:
    """One row for each group: joined text in order, span and count."""
    g = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t")))).alias("x"), F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("segments"))
    return g.select(*keys, F.array_join(F.transform("x", lambda e: e["_t"]), "\n").alias("merged"), "start", "end", "segments")


def session_merge(df: DataFrame, key: str, start: str, end: str, gap: float) -> DataFrame:
    """Neighbouring intervals closer than ``gap`` as one: new sessions are running counts of gaps."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = df.withColumn("_new", F.coalesce((F.col(start) - reach > gap).cast("int"), F.lit(1)))
    s = s.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(key, "session").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("events"))


def _halves(place: Column, size: Column, depth: Column) -> Column:
    """(lo, seg): where the part of 0..size that holds ``place`` begins after ``depth`` halvings, and its number."""
    whole = F.struct(F.lit(0).cast("long").alias("lo"), size.cast("long").alias("hi"), F.lit(0).cast("long").alias("seg"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("long")
        left = place < mid
        return F.struct(F.when(left, s["lo"]).otherwise(mid).alias("lo"), F.when(left, mid).otherwise(s["hi"]).alias("hi"), (s["seg"] * 2 + F.when(left, 0).otherwise(1)).alias("seg"))

    steps = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, whole, halve)


def merge_adjacent(df: DataFrame, key: str, order: str, text: str, same: Callable[[str, str], bool], leaf: int = 4096) -> DataFrame:
    """Divide-and-conquer merge of neighbouring events of a video by a judge of two captions: (key, event, captions).

    Halves are merged first; then the judge sees the first caption of the last event on the
    left and that of the first event on the right, and if it agrees the two become one.  A
    video of more than ``leaf`` rows is cut at the recursion's own midpoints: each part is a
    group of its own, and parts are joined at their borders, a round for each level, knowing
    of each part only its first and last event.  The result is that of the recursion.
    """
    from tessera.operators.batch import with_pos
    from tessera.sources.files import shared_folder

    if leaf < 2:
        raise ValueError("a part needs two rows or more")
    kind, spark = dict(df.dtypes)[key], df.sparkSession
    rows = with_pos(df.select(F.col(key).alias("_key"), F.col(order).alias("_o"), F.col(text).alias("_t")), "_key", "_o", "_t", pos="_pos")
    sizes = rows.groupBy(F.col("_key").alias("_k")).agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    depth = F.greatest(F.ceil(F.log2(F.col("_n") / leaf)), F.lit(0)).cast("int")
    placed = rows.join(sizes, F.col("_key").eqNullSafe(F.col("_k"))).withColumn("_depth", depth)
    placed = placed.withColumn("_h", _halves(F.col("_pos") - F.col("_first"), F.col("_n"), F.col("_depth"))).select("_key", "_depth", "_h.lo", "_h.seg", "_pos", "_t")

    def run(pdf):
        import pandas as pd

        def merge(lo: int, hi: int) -> list[list[str]]:
            if hi - lo == 1:
                return [[captions[lo]]]
            mid = (lo + hi) // 2
            a, b = merge(lo, mid), merge(mid, hi)
            if same(a[-1][0], b[0][0]):
                return [*a[:-1], a[-1] + b[0], *b[1:]]
            return a + b

        captions = pdf.sort_values("_pos")["_t"].tolist()
        return pd.DataFrame({"_key": pdf["_key"].iloc[:1], "depth": pdf["_depth"].iloc[:1], "lo": pdf["lo"].iloc[:1], "seg": pdf["seg"].iloc[:1], "events": [merge(0, len(captions))]})

    parts = placed.groupBy("_key", "seg").applyInPandas(run, f"_key {kind}, depth int, lo long, seg long, events array<array<string>>")
    most = sizes.agg(F.max(depth)).first()[0] or 0
    if not most:
        return parts.select(F.col("_key").alias(key), F.posexplode("events").alias("event", "captions")).withColumn("event", F.col("event").cast("long"))
    folder = shared_folder(spark)

    def kept(table: DataFrame, name: str) -> DataFrame:
        table.write.parquet(f"{folder}/{name}")
        return spark.read.schema(table.schema).parquet(f"{folder}/{name}")

    parts = kept(parts, "parts")
    part = F.struct("lo", "first", "last", "single")
    now = parts.select("_key", "depth", "seg", "lo", F.col("events")[0][0].alias("first"), F.element_at("events", -1)[0].alias("last"), (F.size("events") == 1).alias("single"))
    judge = F.pandas_udf(lambda a, b: (a.astype(object).combine(b.astype(object), lambda x, y: bool(same(x, y)))).astype(bool), "boolean")
    borders = []
    for level in range(most, 0, -1):
        pairs = now.where(F.col("depth") == level).groupBy("_key", F.floor(F.col("seg") / 2).alias("seg")).agg(F.min_by(part, "seg").alias("l"), F.max_by(part, "seg").alias("r"))
        pairs = kept(pairs.withColumn("joined", judge("l.last", "r.first")), f"level{level}")
        borders.append(pairs.select("_key", "r.lo", "joined"))
        both = F.col("joined")
        merged = pairs.select("_key", F.lit(level - 1).alias("depth"), "seg", "l.lo", "l.first", F.when(both & F.col("r.single"), F.col("l.last")).otherwise(F.col("r.last")).alias("last"), (both & F.col("l.single") & F.col("r.single")).alias("single"))
        now = now.where(F.col("depth") < level).unionByName(merged)
    joins = borders[0]
    for b in borders[1:]:
        joins = joins.unionByName(b)
    joins = joins.toDF("_jk", "_jlo", "joined")
    parts = parts.join(joins, F.col("_key").eqNullSafe(F.col("_jk")) & (F.col("lo") == F.col("_jlo")), "left").withColumn("joined", F.coalesce("joined", F.lit(False)).cast("int"))
    earlier = Window.partitionBy("_key").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    begun = parts.select("_key", "lo", "joined", F.size("events").alias("_size")).withColumn("_before", F.coalesce(F.sum(F.col("_size") - F.col("joined")).over(earlier), F.lit(0)))
    parts = parts.drop("joined", "_jk", "_jlo").join(begun.select(F.col("_key").alias("_bk"), F.col("lo").alias("_blo"), "joined", "_before"), F.col("_key").eqNullSafe(F.col("_bk")) & (F.col("lo") == F.col("_blo")))
    pieces = parts.select("_key", "lo", "_before", "joined", F.posexplode("events").alias("_i", "_c"))
    events = pieces.groupBy(F.col("_key").alias(key), (F.col("_before") + F.col("_i") - F.col("joined")).cast("long").alias("event")).agg(F.sort_array(F.collect_list(F.struct("lo", "_c"))).alias("_x"))
    return events.select(key, "event", F.flatten(F.transform("_x", lambda x: x["_c"])).alias("captions"))


def tree_merge(df: DataFrame, key: str, idx: str, text: str, rounds: int | None = None) -> DataFrame:
    """Pairwise rounds until one text for each key is left; an odd block is carried on."""
    cur = df.select(key, F.col(idx).cast("long").alias("i"), F.col(text).alias("t"))
    most = rounds if rounds is not None else math.ceil(math.log2(max(2, (cur.groupBy(key).count().agg(F.max("count")).first()[0] or 1))))
    for _ in range(most):
        cur = cur.groupBy(key, F.floor(F.col("i") / 2).alias("i")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("i").alias("o"), "t"))), lambda e: e["t"]), "+").alias("t"))
    return cur.select(key, F.col("t").alias("merged"))


def dyadic_cover(low: Column, high: Column) -> Column:
    """The fewest (level, node) that cover the integers low..high: node k of a level holds k * 2 ** level and what follows up to the next; two at most for each level."""
    end = high + 1
    levels = F.sequence(F.lit(0), F.floor(F.log2((end - low).cast("double"))).cast("int") + 1)

    def nodes(level: Column) -> Column:
        step = F.expr("1L") * F.pow(F.lit(2.0), level).cast("long")
        left, right = F.ceil(low / step), F.floor(end / step)
        node = lambda ok, at: F.when((left < right) & ok, F.struct(level.cast("int").alias("level"), at.cast("long").alias("node")))
        return F.array(node(F.pmod(left, F.lit(2)) == 1, left), node(F.pmod(right, F.lit(2)) == 1, right - 1))

    return F.filter(F.flatten(F.transform(levels, nodes)), lambda x: x.isNotNull())


def dyadic_pairs(points: DataFrame, intervals: DataFrame, key: str, cell: Column, low: Column, high: Column) -> DataFrame:
    """Points and intervals of a key that share a cell, each pair once: intervals as their cover, points with their ancestors at the levels that covers have.

    An interval of n cells makes at most 2 log2(n) + 2 rows and a point one row for each
    level, whatever the width of a cell; the levels, 63 at most, are one broadcast row.
    """
    covered = intervals.withColumn("_n", F.explode(dyadic_cover(low, high))).withColumns({"_level": F.col("_n.level"), "_node": F.col("_n.node")}).drop("_n")
    levels = intervals.select(F.explode(F.transform(dyadic_cover(low, high), lambda n: n["level"])).alias("_l")).agg(F.collect_set("_l").alias("_levels"))
    placed = points.withColumn("_cell", cell.cast("long")).crossJoin(F.broadcast(levels)).withColumn("_level", F.explode("_levels"))
    placed = placed.withColumn("_node", F.floor(F.col("_cell") / F.pow(F.lit(2.0), F.col("_level")).cast("long"))).drop("_cell", "_levels")
    return placed.join(covered, [key, "_level", "_node"]).drop("_level", "_node")


def range_join(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, key: str, width: float) -> DataFrame:
    """Points inside [start, end) of the same key. ``width`` is the cell that both sides are rounded to before the exact comparison."""
    first = F.floor(F.col(start) / width)
    last = F.greatest(F.ceil(F.col(end) / width) - 1, first)
    met = dyadic_pairs(points, intervals.where(F.col(end) > F.col(start)), key, F.floor(F.col(point) / width), first, last)
    return met.where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end)))


def covered_points(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, key: str, width: float) -> DataFrame:
    """Points strictly inside some interval of their key; each distinct (key, point) is looked up once."""
    spans = intervals.where(F.col(end) > F.col(start)).select(key, F.col(start).alias("_s"), F.col(end).alias("_e"))
    met = dyadic_pairs(points.select(key, point).distinct(), spans, key, F.floor(F.col(point) / width), F.floor(F.col("_s") / width), F.floor(F.col("_e") / width))
    inside = met.where((F.col(point) > F.col("_s")) & (F.col(point) < F.col("_e"))).select(key, point).distinct()
    return points.join(inside, [key, point], "left_semi")


def fallback_lookup(df: DataFrame, index: DataFrame, name: str, suffix: str = ".mp4") -> DataFrame:
    """Path by exact name, else with the suffix added, else with it removed; the first of these that exists."""
    tries = F.array(F.col(name), F.concat(name, F.lit(suffix)), F.regexp_replace(name, suffix.replace(".", r"\.") + r"\z", ""))
    t = df.select(name, F.posexplode(tries).alias("_p", "_n")).distinct().join(index.toDF("_n", "_path"), "_n")
    best = t.groupBy(name).agg(F.min_by("_path", "_p").alias("path"))
    return df.join(best, name, "left")


def unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key), key, "left_anti")


def attach_rank(df: DataFrame, selected: DataFrame, key: str, ids: str, item: str) -> DataFrame:
    """Rows whose item is in the key's list of selected ids, with the 1-based place in it."""
    s = selected.select(key, F.posexplode(ids).alias("_p", item))
    return df.join(s, [key, item]).withColumn("rank", F.col("_p") + 1).drop("_p")


def teams(df: DataFrame, key: str, k: int) -> DataFrame:
    """Sorted distinct keys dealt round robin to ``k`` teams."""
    from tessera.operators.batch import with_pos

    dealt = with_pos(df.select(key).distinct(), key, pos="_p").select(key, (F.col("_p") % k).alias("team"))
    return df.join(dealt, key)


def pipeline_call(df: DataFrame, client: Callable[[str], str], prompt: str, out: str) -> DataFrame:
    """A row-wise external call (a model) on a prompt column, in Arrow batches of some MB, whatever the prompts' length; failures give null."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(s):
        def one(x):
            try:
                return client(x)
            except Exception:  # noqa: BLE001  a failing call is a missing reply
                return None

        return s.map(one)

    return df.withColumn(out, F.pandas_udf(run, "string")(prompt))
