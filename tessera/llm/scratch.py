"""Shared-storage tables, size-checked broadcasts and Arrow plumbing for the corpus operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import tessera

#: A side of at most so many values (columns and array elements of all rows) is broadcast: tens of MB as a hash relation.
BROADCAST_VALUES = 1_500_000

#: Rows of an Arrow batch: whole texts, some of them long, and a worker holds two or three copies of a batch.
BATCH_ROWS = 1000


def release() -> None:
    """Give memory that is no longer used back to the system: driver and workers live on after a table is done."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of this session's own only where the cluster names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(named)
    return named


class Scratch:
    """Tables written to the shared folder: lineage ends there, and a lost executor loses nothing."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:02d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        release()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _values(kind: T.DataType, value: Column) -> Column:
    """How many primitive values a column's value holds."""
    if isinstance(kind, T.ArrayType):
        inner = len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 1
        return F.coalesce(F.size(value), F.lit(0)) * inner + 1
    if isinstance(kind, T.StringType):
        return F.coalesce(F.length(value), F.lit(0)) / 16 + 1
    return F.lit(1)


def small(df: DataFrame, values: int = BROADCAST_VALUES) -> DataFrame:
    """``df`` marked for broadcast if a count of its values shows that it is small; else as it is, for a shuffled join."""
    total = sum((_values(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(total)).first()[0] or 0) <= values else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application; keep Arrow batches of whole texts small."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if getattr(sc, "_tessera_shipped", False):
        return
    top = Path(tessera.__file__).parent
    out = os.path.join(tempfile.mkdtemp(), "tessera-code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"tessera/{f.relative_to(top)}")
    sc.addPyFile(out)
    sc._tessera_shipped = True


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, one call for each record batch."""
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)
        release()

    return df.mapInArrow(run, schema)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def row_key(doc_id: Column, digest: Column) -> Column:
    """128-bit identity of a row: its doc_id (null is one, too) and the digest of its text."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), digest).cast("binary")))


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs meets one of an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def columns_of(row: str, docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` out of a struct that ``whole_row`` made."""
    return [F.col(row).getField(c).alias(c) for c in docs.columns]


def texts_of(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns an operator works on, whatever else the table holds."""
    return docs.select(*(F.col(f"`{c}`") for c in ("doc_id", "text", *keep)))




def merge_ranges(df: DataFrame, key: str, kind: str = "long") -> DataFrame:
    """Per key, the union of its (low, high) ranges of integers, as two arrays; ranges that touch become one."""
    ordered = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("x")).select(key, F.col("x.low").alias("low"), F.col("x.high").alias("high"))

    def run(rows):
        out = []
        for low, high in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist()):
            lows, highs = [], []
            for a, b in zip(low, high):
                if highs and a <= highs[-1] + 1:
                    highs[-1] = max(highs[-1], b)
                else:
                    lows.append(a)
                    highs.append(b)
            out.append((lows, highs))
        yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(x, pa.list_(pa.int64())) for x in zip(*out))], names=[key, "low", "high"])

    return arrow_map(ordered, run, f"{key} {kind}, low array<long>, high array<long>")
