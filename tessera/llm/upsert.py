"""Keyed upserts into a folder of sorted Parquet files, copy on write.

A folder holds files of at most ``rows_per_file`` rows, sorted by a key; each file but
the first begins where its left neighbour has ended.  A change has a home: the last file
that begins at or below its key, else the first.  Footers give each file's smallest and
largest key (its fence) without a look at the rows, and a table of split-block Bloom
filters, one row for each 256-bit block, says which keys a file can hold.  Both prune
deletes of absent keys; what remains meets the rows in one exact join on the key, and
only files with a row that really changes are read whole, merged and written anew.

Homes come from one sort of fences and changes together and a running "last fence", kept
for each range partition and carried over the borders (one row a partition), so neither
changes nor fences are sent to all tasks.  What the driver sees is file paths, as Spark's
own file index does, and counts.

Defined results: changes with a null key are ignored; rows of the folder with a null key
stand first and never change; rows that repeat a key change together, whatever file they
are in; of equal changes to one key any is as good as the other; without a starting file
there are no homes, so nothing is inserted; a file that loses all rows goes; further
columns of the rows stay as they are and are null in inserted rows.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import scratch as S

#: Bits of a Bloom filter for each row that a file may have.
BITS_PER_ROW = 12


def numbered(df: DataFrame, order: list[str], scratch: S.Scratch, name: str) -> DataFrame:
    """``df`` with ``pos``, its rows' places from 0 on in a total order: a range sort, and offsets of the partitions (one row each)."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = scratch.write(parts.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("size")).select("_part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_base"))
    return parts.join(F.broadcast(sizes), "_part").withColumn("pos", F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def filled_forward(df: DataFrame, order: list[str], mark: str, scratch: S.Scratch, name: str) -> DataFrame:
    """``df`` with ``mark`` replaced by its last value that is not null, in a total order; before the first one, by the least of all."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = scratch.write(parts.withColumn("_seen", F.last(mark, ignorenulls=True).over(within)), name)
    every, before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = parts.groupBy("_part").agg(F.max("_seen").alias("end"), F.min(mark).alias("least"))
    carry = ends.select("_part", F.coalesce(F.last("end", ignorenulls=True).over(before), F.min("least").over(every)).alias("_carry"))
    return parts.join(F.broadcast(carry), "_part").withColumn(mark, F.coalesce("_seen", "_carry")).drop("_part", "_seen", "_carry")


class KeyedFiles:
    """Sorted Parquet files of at most ``rows_per_file`` rows in one folder."""

    def __init__(self, spark: SparkSession, key: str, rows_per_file: int):
        self.spark, self.key, self.rows_per_file = spark, key, int(rows_per_file)
        self.scratch = S.Scratch(spark)
        self.folder = f"{S.checkpoint_dir(spark).rstrip('/')}/keyed-files-{uuid.uuid4().hex}"  # holds nothing but the files

    # -- the folder -----------------------------------------------------------------

    def _tie(self) -> Column:
        return F.md5(F.to_json("row").cast("binary"))

    def start(self, rows: DataFrame) -> KeyedFiles:
        """Write ``rows`` as files of ``rows_per_file`` rows in the order of the key; the last has the rest."""
        self.schema = rows.schema
        held = rows.select(F.col(f"`{self.key}`").alias("id"), S.whole_row(rows).alias("row")).withColumn("tie", self._tie())
        placed = numbered(held, ["id", "tie"], self.scratch, "sorted").withColumn("file", F.expr(f"cast(pos div {self.rows_per_file} as int)"))
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
        self._write(placed, placed.agg(F.max("file")).first()[0])
        self.filters = self._filters_of(self.rows())
        return self

    def _write(self, placed: DataFrame, last: int | None) -> None:
        """One file for each number in ``file``, 0 to ``last``: a task writes each, streaming."""
        if last is not None:
            placed.repartitionById(last + 1, F.col("file")).sortWithinPartitions("id", "tie").select("row.*").write.mode("append").parquet(self.folder)
            S.release()

    def rows(self, paths: list[str] | None = None, index: bool = False) -> DataFrame:
        """(id, path, row) of all files, or of those named; ``index``: with each row's place in its file. No files, no rows."""
        rows = self.spark.read.schema(self.schema).parquet(*([self.folder] if paths is None else paths))
        at = [F.col("_metadata.row_index").alias("index")] if index else []
        return rows.select(F.col(f"`{self.key}`").alias("id"), F.col("_metadata.file_path").alias("path"), S.whole_row(rows).alias("row"), *at)

    def files(self) -> DataFrame:
        """(path, first, last, n, names) of each file that has rows, from the footers."""
        kind = self.schema[self.key].dataType.simpleString()
        listed = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self.folder).select(F.col("_metadata.file_path").alias("path"))
        try:
            pyarrow.fs.FileSystem.from_uri(self.folder)
        except (pa.ArrowInvalid, OSError):  # a store that only Spark's readers know: the key's column instead of its statistics
            ends = self.rows().groupBy("path").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
            return ends.withColumn("names", F.lit(",".join(self.schema.names)))
        key = self.key

        def footers(batch):
            out = []
            for path in batch.column(0).to_pylist():
                fs, name = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as f:
                    about = pq.ParquetFile(f)
                    at, groups = about.schema_arrow.names.index(key), about.metadata.num_row_groups
                    stats = [about.metadata.row_group(g).column(at).statistics for g in range(groups)]
                    ends = [(s.min, s.max) for s in stats if s is not None and s.has_min_max]
                    if about.metadata.num_rows:
                        out.append((path, min((a for a, _ in ends), default=None), max((b for _, b in ends), default=None), about.metadata.num_rows, ",".join(about.schema_arrow.names)))
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "first", "last", "n", "names"), x)) for x in out], schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        schema = StructType.fromDDL(f"path string, first {kind}, last {kind}, n long, names string")
        arrow = to_arrow_schema(schema)
        return S.arrow_map(listed, footers, schema)

    # -- Bloom filters ----------------------------------------------------------------

    def _block(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(-(-self.rows_per_file * BITS_PER_ROW // 256))).cast("int")

    def _words(self, key: str) -> list[Column]:
        """The eight bits of a key in its block's four 64-bit words: one in each half."""
        bit = lambda i: F.expr(f"shiftleft(1L, cast(shiftright(xxhash64({key}, 1), {5 * i}) & 31 as int) + {32 * (i % 2)})")
        return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(4)]

    def _filters_of(self, rows: DataFrame) -> DataFrame:
        """(path, block, w0 .. w3): a row for each 256-bit block that has a bit."""
        keyed = rows.where("id is not null").select("path", self._block("id").alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(self._words("id"))])
        return self.scratch.write(keyed.groupBy("path", "block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)]), "filters")

    # -- changes ------------------------------------------------------------------------

    def route(self, changes: DataFrame) -> DataFrame:
        """Changes (id, change), at most one for each id, with their ``home``: (first, last, path) of a file."""
        files = self.scratch.write(self.files(), "fences")
        home = F.struct("first", "last", "path")
        fences = files.select(F.col("first").alias("id"), F.lit(0).alias("side"), "path", home.alias("home"), F.lit(None).cast(changes.schema["change"].dataType).alias("change"))
        both = fences.unionByName(changes.where("id is not null").select("id", F.lit(1).alias("side"), F.lit("").alias("path"), F.lit(None).cast(fences.schema["home"].dataType).alias("home"), "change"))
        return filled_forward(both, ["id", "side", "path"], "home", self.scratch, "routed").where("side = 1 and home is not null").select("id", "change", "home")

    def _remaining(self, changes: DataFrame) -> DataFrame:
        """Without deletes of keys outside their home's fence or absent from its filter."""
        deletes = changes.where("change.gone").where("id between home.first and home.last").select("id", "change", "home", F.col("home.path").alias("path"), self._block("id").alias("block"))
        hit = deletes.join(self.filters, ["path", "block"])
        for i, word in enumerate(self._words("id")):
            hit = hit.where(F.col(f"w{i}").bitwiseAND(word) == word)
        return hit.select("id", "change", "home").unionByName(changes.where("not change.gone").select("id", "change", "home"))

    def _differences(self, remaining: DataFrame, columns: list[str]) -> DataFrame:
        """(id, change, path, found, home): changes that the exact join shows to change a row, with the file it is in or belongs into."""
        homes = remaining.select(F.col("home.path").alias("path"), F.col("home.first").alias("first")).distinct()
        earlier = self.scratch.write(self.files(), "fences").join(homes.select(F.col("first").alias("last")).distinct(), "last", "left_semi").select("path")  # may end with the same key
        paths = [r["path"] for r in homes.select("path").unionByName(earlier).distinct().toLocalIterator()]
        if not paths:
            return remaining.select("id", "change", F.lit("").alias("path"), F.lit(True).alias("found"), "home").limit(0)
        now = self.rows(paths).select("id", "path", F.struct(*[F.col("row").getField(c).alias(c) for c in columns]).alias("now"))
        met = remaining.join(now, "id", "left")
        same = F.lit(True)
        for c in columns:
            same = same & F.col("change")[c].eqNullSafe(F.col("now")[c])
        met = met.where(F.when(F.col("change.gone"), F.col("path").isNotNull()).otherwise(F.col("path").isNull() | ~same))
        return met.select("id", "change", F.coalesce("path", F.col("home.path")).alias("path"), F.col("path").isNotNull().alias("found"), "home").dropDuplicates(["path", "id"])

    def apply(self, changes: DataFrame, columns: list[str]) -> DataFrame:
        """Carry out routed changes, whose ``change`` holds ``gone`` (delete) and new values of ``columns``; gives (path) of the files replaced."""
        diffs = self.scratch.write(self._differences(self.scratch.write(self._remaining(changes), "remaining"), columns), "differences")
        replaced = self.scratch.write(diffs.select("path").distinct(), "replaced")
        paths = [r["path"] for r in replaced.toLocalIterator()]
        if not paths:
            return replaced
        before = self.files()
        firsts = before.select("path", "first")
        files = self.scratch.write(before.join(replaced.withColumn("hit", F.lit(True)), "path", "left"), "before")
        old = self.rows(paths).join(diffs.where("found").select("path", "id", "change"), ["path", "id"], "left").where("change is null or not change.gone")
        old = old.select("id", "path", F.struct(*[(F.when(F.col("change").isNotNull(), F.col("change").getField(c)).otherwise(F.col("row").getField(c)) if c in columns else F.col("row").getField(c)).alias(c) for c in self.schema.names]).alias("row"))
        new = diffs.where("not found and not change.gone")
        new = new.select("id", "path", F.struct(*[(F.col("id") if c == self.key else F.col("change").getField(c) if c in columns else F.lit(None)).cast(self.schema[c].dataType).alias(c) for c in self.schema.names]).alias("row"))
        rows = numbered(old.unionByName(new).join(firsts, "path").withColumn("tie", self._tie()), ["first", "path", "id", "tie"], self.scratch, "merged")
        rows = self.scratch.write(rows, "placed")
        # as few files as hold a home's rows, sizes at most one apart, larger ones first
        homes = rows.groupBy("path").agg(F.min("first").alias("first"), F.min("pos").alias("base"), F.count("*").alias("n"))
        homes = homes.withColumn("k", F.ceil(F.col("n") / self.rows_per_file).cast("long")).withColumns({"size": F.expr("n div k"), "larger": F.expr("n % k")})
        homes = self.scratch.write(homes, "homes")
        parts = homes.select("path", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("part"), "size", "larger")
        parts = parts.select("path", "first", "part", (F.col("size") + (F.col("part") < F.col("larger")).cast("long")).alias("n"))
        target = self._joined(files, parts)
        at = F.col("pos") - F.col("base")
        cut = F.col("larger") * (F.col("size") + 1)
        part = F.when(at < cut, F.floor(at / (F.col("size") + 1))).otherwise(F.col("larger") + F.floor((at - cut) / F.col("size"))).cast("long")
        placed = rows.drop("first").join(homes.drop("first", "n", "k"), "path").withColumn("part", part).join(target, ["path", "part"])
        self._write(placed.select("id", "tie", "row", "file"), target.agg(F.max("file")).first()[0])
        self._remove(paths)
        kept = self.filters.join(replaced, "path", "left_anti")
        written = self.files().join(files.select("path"), "path", "left_anti").select("path")
        written = [r["path"] for r in written.toLocalIterator()]
        self.filters = kept.unionByName(self._filters_of(self.rows(written))) if written else kept
        return replaced

    def _joined(self, files: DataFrame, parts: DataFrame) -> DataFrame:
        """(path, part, file): small rewritten neighbours join from left to right while both fit one file; files are numbered from 0 on.

        Files that stay part the new ones into runs; a run's sizes, one number a file, are folded together.
        """
        order = ["first", "path", "part"]
        stays = files.where("hit is null").select("first", "path", F.lit(-1).cast("long").alias("part"), F.lit(0).cast("long").alias("n"), F.struct("first", "path").alias("run"))
        runs = filled_forward(stays.unionByName(parts.withColumn("run", F.lit(None).cast(stays.schema["run"].dataType)).select(*order, "n", "run")), order, "run", self.scratch, "runs")
        runs = runs.where("part >= 0").withColumn("run", F.coalesce(F.xxhash64("run"), F.lit(0)))
        # before the first file that stays, a run of its own
        first_stay = stays.agg(F.min(F.struct("first", "path")).alias("lead"))
        runs = runs.crossJoin(F.broadcast(first_stay)).withColumn("run", F.when(F.struct("first", "path") < F.col("lead"), F.lit(-1)).otherwise(F.col("run"))).drop("lead")
        most = self.rows_per_file

        def fold(run):
            run, lead, held = run.sort_values(order), [], 0
            for i, n in enumerate(run["n"]):
                fits = bool(lead) and held + n <= most
                lead.append(lead[-1] if fits else i)
                held = held + n if fits else n
            return run.assign(**{f"lead_{c}": run[c].to_numpy()[lead] for c in order})[["path", "part", *(f"lead_{c}" for c in order)]]

        kinds = {f.name: f.dataType.simpleString() for f in runs.schema.fields}
        S.ship(self.spark)
        schema = "path string, part long, " + ", ".join(f"lead_{c} {kinds[c]}" for c in order)
        met = self.scratch.write(runs.groupBy("run").applyInPandas(fold, schema), "joined")
        leads = [f"lead_{c}" for c in order]
        files_out = numbered(met.select(*leads).distinct(), leads, self.scratch, "numbered").withColumn("file", F.col("pos").cast("int")).drop("pos")
        return self.scratch.write(met.join(files_out, leads).select("path", "part", "file"), "targets")

    def _remove(self, paths: list[str]) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
            at.getFileSystem(conf).delete(at, False)


def latest_changes(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(id, change): of each key the row that is last by ``order``; pre-aggregated, so that a hot key costs no more."""
    rest = sorted(set(changes.columns) - {key} - set(order))
    rank = F.struct(*[F.col(f"`{c}`") for c in order], F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest])).cast("binary")))
    return changes.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("id")).agg(F.max_by(S.whole_row(changes), rank).alias("change"))


def crc(value: Column) -> Column:
    return F.crc32(value.cast("string").cast("binary"))
