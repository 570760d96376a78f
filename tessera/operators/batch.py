"""Keyed batch algebra: every row has an explicit order column, so no operator depends on physical position.

Dense positions come from ``with_pos``: a range sort, written once, and per-partition
offsets, not a window over one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_pos(df: DataFrame, *order: str, pos: str = "pos") -> DataFrame:
    """Dense 0-based positions in the given (total) order.

    The sorted rows are written once, with their partition and place: a range sort that runs
    a second time may draw other borders, and its counts would not be those of the rows.
    """
    from tessera.sources.files import shared_folder

    keys, spark, folder = [F.col(c) for c in order], df.sparkSession, shared_folder(df.sparkSession)
    parts = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % F.lit(1 << 33))
    parts.write.option("compression", "zstd").parquet(folder)
    parts = spark.read.schema(parts.schema).parquet(folder)
    sizes = parts.groupBy("_pid").agg(F.count("*").alias("_n"))
    running = F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))  # one row for each partition
    before = sizes.select("_pid", F.coalesce(running, F.lit(0)).alias("_base"))
    return parts.join(F.broadcast(before), "_pid").withColumn(pos, (F.col("_base") + F.col("_at")).cast("long")).drop("_pid", "_at", "_base")


def select(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def pop(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(popped, rest); an unknown column is an error."""
    missing = set(columns) - set(df.columns)
    if missing:
        raise KeyError(f"no such columns: {sorted(missing)}")
    return df.select(*columns), df.drop(*columns)


def rename(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return df.withColumnsRenamed(dict(zip(old, new)))


def gather(df: DataFrame, index: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows at ``index`` (columns out_pos, pos), repeats allowed; the result is ordered by ``out_pos``."""
    return index.join(df, pos).drop(pos).withColumnRenamed("out_pos", pos)


def take_mask(df: DataFrame, mask: Column) -> DataFrame:
    return df.where(mask)


def slice_rows(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1, pos: str = "pos") -> DataFrame:
    p, low = F.col(pos), start or 0
    keep = (p >= low) & ((p - low) % step == 0)
    return df.where(keep if stop is None else keep & (p < stop))


def take(df: DataFrame, item, pos: str = "pos") -> DataFrame:
    """Rows by int, slice, list of ints or boolean Column."""
    if isinstance(item, int):
        return df.where(F.col(pos) == item)
    if isinstance(item, slice):
        return slice_rows(df, item.start, item.stop, item.step or 1, pos)
    if isinstance(item, Column):
        return take_mask(df, item)
    return gather(df, df.sparkSession.createDataFrame(list(enumerate(item)), f"out_pos long, {pos} long"), pos)


def union_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Join of two batches row by row; columns on both sides must be equal (NaN equals NaN, null equals null)."""
    both = [c for c in right.columns if c in left.columns and c != key]
    r = right.select(key, *[F.col(c).alias(f"_r_{c}") for c in both], *[c for c in right.columns if c not in left.columns])
    out = left.join(r, key)
    for c in both:
        out = out.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(left.schema[c].dataType)))
    return out.drop(*[f"_r_{c}" for c in both])


def union_meta(a: dict, b: dict) -> dict:
    """Merged metadata; a key with two values is an error."""
    for k in a.keys() & b.keys():
        if a[k] != b[k]:
            raise ValueError(f"{k} has two values")
    return a | b


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, with the ordinal of their frame in ``part``."""
    out = frames[0].withColumn("part", F.lit(0))
    for i, f in enumerate(frames[1:], 1):
        out = out.unionByName(f.withColumn("part", F.lit(i)))
    return out


def repeat(df: DataFrame, times: int, interleave: bool = True, pos: str = "pos", rows: int | None = None) -> DataFrame:
    """Every row ``times`` times; new positions interleave copies (a, a, b, b) or tile the batch (a, b, a, b)."""
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times else df.withColumn("copy", F.lit(0)).where("false")
    if interleave:
        return out.withColumn(pos, F.col(pos) * times + F.col("copy"))
    return out.withColumn(pos, F.col("copy") * F.lit(df.count() if rows is None else rows) + F.col(pos))


def repeat_by(df: DataFrame, times: str) -> DataFrame:
    """Every row as often as its column ``times`` says."""
    return df.where(F.col(times) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))


def unfold_columns(df: DataFrame, n: int, columns: Sequence[str]) -> DataFrame:
    """Array columns cut into ``n`` equal chunks, one row each; others repeat."""
    out = df.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    for c in columns:
        size = (F.size(c) / n).cast("int")
        out = out.withColumn(c, F.slice(c, F.col("chunk") * size + 1, size))
    return out


def fold(df: DataFrame, size: int, columns: Sequence[str], pos: str = "pos") -> DataFrame:
    """Arrays of ``size`` consecutive rows."""
    g = df.groupBy(F.floor(F.col(pos) / size).alias(pos)).agg(F.sort_array(F.collect_list(F.struct(pos, *columns))).alias("x"))
    return g.select(pos, *[F.col(f"x.{c}").alias(c) for c in columns])


def unfold(df: DataFrame, size: int, columns: Sequence[str], pos: str = "pos") -> DataFrame:
    return df.select((F.col(pos) * size).alias("_base"), F.posexplode(F.arrays_zip(*columns)).alias("_i", "x")).select((F.col("_base") + F.col("_i")).alias(pos), *[f"x.{c}" for c in columns])


def pad_to_multiple(df: DataFrame, divisor: int, pos: str = "pos") -> tuple[DataFrame, int]:
    """Head rows recycled until ``divisor`` divides the row count, marked ``is_pad``; and their number."""
    n = df.count()
    pad = -n % divisor if n else 0
    out = df.withColumn("is_pad", F.lit(False))
    for r in range(-(-pad // n) if n else 0):
        own = df.where(F.col(pos) < min(n, pad - r * n)).withColumn("is_pad", F.lit(True))
        out = out.unionByName(own.withColumn(pos, F.col(pos) + n * (r + 1)))
    return out, pad


def unpad(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_pad")).drop("is_pad")


def pad_with_edge(df: DataFrame, n: int, first: bool = False, pos: str = "pos") -> DataFrame:
    """``n`` more copies of the last (or first) row."""
    rows = df.count()
    edge = df.where(F.col(pos) == (0 if first else rows - 1))
    return df.unionByName(edge.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(pos, F.lit(rows) + F.col("_i")).drop("_i")) if n else df


def chunk_of(pos: Column, rows: int, chunks: int, padding: bool = False) -> Column:
    """Equal chunk number of a position; uneven batches are an error unless padded."""
    if rows % chunks and not padding:
        raise ValueError(f"{rows} rows do not make {chunks} equal chunks")
    return F.floor(pos / (-(-rows // chunks))).cast("long")


def split_of(pos: Column, size: int) -> Column:
    return F.floor(pos / size).cast("long")


def strided_shard(df: DataFrame, shards: int, index: int, pos: str = "pos") -> DataFrame:
    return df.where(F.col(pos) % shards == index)


def contiguous_shard(df: DataFrame, rows: int, shards: int, index: int, pos: str = "pos") -> DataFrame:
    """Runs of rows // shards; the last shard takes the remainder."""
    per = max(rows // shards, 1)
    return df.where(F.least(F.floor(F.col(pos) / per), F.lit(shards - 1)) == index)


def seeded_order(*columns: str, seed: int = 0) -> Column:
    """A sort key that shuffles rows alike in every engine: md5 of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def minibatches(df: DataFrame, size: int, epochs: int, seed: int, key: str) -> DataFrame:
    """(epoch, batch) of each row: a seeded permutation for each epoch, cut into batches."""
    e = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    e = e.withColumn("_k", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.col(key).cast("string")).cast("binary")))
    e = with_pos(e, "epoch", "_k", pos="_p")
    return e.withColumn("batch", F.floor((F.col("_p") - F.col("epoch") * df.count()) / size).cast("long")).drop("_k", "_p")
