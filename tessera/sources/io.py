"""Readers and writers: prompt, conversation and preference tables, JSON and JSONL dumps, subtitles, path lists, metric sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_prompts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Union of prompt tables by name; columns that some files lack are null."""
    out = None
    for p in paths:
        one = spark.read.parquet(p)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_sft(spark: SparkSession, path: str, prompt: str, response: str) -> DataFrame:
    """Single-turn rows; keys may be nested ("extra_info.answer")."""
    return spark.read.parquet(path).select(F.col(prompt).alias("prompt"), F.col(response).alias("response"))


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Multi-turn rows; ``tools`` and ``enable_thinking`` where the file has them."""
    df = spark.read.parquet(path)
    return df.select("messages", *[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in ("tools", "enable_thinking")])


def read_preferences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("prompt", "chosen", "rejected")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_json_tree(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """All JSON files below a folder, with their path in ``file``."""
    r = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    return (r.schema(schema) if schema else r).json(path).withColumn("file", F.col("_metadata.file_path"))


def merge_json(spark: SparkSession, path: str) -> DataFrame:
    return read_json_tree(spark, path).drop("file").orderBy("video_path", "start_time")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file without blank ones and # comments."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> '' and path not like '#%'")


def index_files(spark: SparkSession, folder: str, suffix: str = ".mp4", first: bool = True) -> DataFrame:
    """name -> path of the files below a folder; of equal names the first (or last) path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder).select("path")
    name = F.regexp_extract("path", r"([^/]+)" + suffix.replace(".", r"\.") + r"\z", 1)
    return files.groupBy(name.alias("name")).agg((F.min if first else F.max)("path").alias("path"))


def read_steps(spark: SparkSession, folder: str, mask: Sequence[str] = ()) -> DataFrame:
    """JSONL dumps, one file for each step; ``step`` from the file name, patterns of ``mask`` blanked in strings."""
    df = spark.read.json(folder).withColumn("step", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.jsonl?\z", 1).cast("int"))
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            for m in mask:
                df = df.withColumn(f.name, F.regexp_replace(f.name, m, ""))
    return df


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """Subtitles as (start, end, text) in seconds."""
    from tessera.functions.text import clock_seconds

    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.regexp_replace("value", "\r", ""), r"\n\s*\n")).alias("b"))
    times = r"(\d+:\d+:\d+[,.]\d+) --> (\d+:\d+:\d+[,.]\d+)"
    return blocks.where(F.col("b").rlike(times)).select(clock_seconds(F.regexp_extract("b", times, 1)).alias("start"), clock_seconds(F.regexp_extract("b", times, 2)).alias("end"), F.regexp_replace(F.regexp_extract("b", r"(?s)-->[^\n]*\n(.*)", 1), r"\A\s+|\s+\z", "").alias("text"))


def write_steps(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("step").json(path)


def write_teams(df: DataFrame, path: str, key: str, k: int) -> None:
    from tessera.operators.curation import teams

    teams(df, key, k).write.partitionBy("team").json(path)


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def flatten_struct(df: DataFrame, sep: str = "/") -> DataFrame:
    """Leaves of nested structs as columns named by their path."""

    def leaves(kind: T.StructType, at: list[str]) -> list[Column]:
        out = []
        for f in kind.fields:
            here = [*at, f.name]
            out += leaves(f.dataType, here) if isinstance(f.dataType, T.StructType) else [F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here))]
        return out

    return df.select(*leaves(df.schema, []))


def metric_rows(metrics: dict[str, float], step: int) -> list[tuple[int, str, float]]:
    return [(step, k, float(v)) for k, v in sorted(metrics.items())]


class MetricSink:
    """Long metric table (step, name, value), appended as Parquet; further sinks are callables of a step's rows."""

    def __init__(self, spark: SparkSession, path: str, *more):
        self.spark, self.path, self.more = spark, path, more

    def log(self, metrics: dict[str, float], step: int) -> None:
        rows = metric_rows(metrics, step)
        self.spark.createDataFrame(rows, "step int, name string, value double").coalesce(1).write.mode("append").parquet(self.path)
        for sink in self.more:
            sink(rows)


def char_count_source(ids: DataFrame, seed: int = 0) -> DataFrame:
    """For each id a prompt that asks for the number of a letter in a short word."""
    letters = F.array(*map(F.lit, "abcdefghijklmnopqrstuvwxyz"))
    pick = lambda i, j: F.element_at(letters, (F.pmod(F.xxhash64(F.lit(seed), i, j), F.lit(26)) + 1).cast("int"))
    word = F.array_join(F.transform(F.sequence(F.lit(0), (F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(3)) + 2).cast("int")), lambda j: pick(F.col("id"), j)), "")
    df = ids.select("id", word.alias("word"), pick(F.col("id"), F.lit(-1)).alias("letter"))
    n = F.length("word") - F.length(F.replace("word", "letter", F.lit("")))
    return df.select("id", F.format_string("How many %s are there in %s?", "letter", "word").alias("prompt"), F.format_string("\\boxed{%d}", n).alias("response"))


def math_source(ids: DataFrame, seed: int = 0) -> DataFrame:
    """For each id an arithmetic prompt with its value."""
    d = lambda j: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(j)), F.lit(10))).cast("int")
    return ids.select("id", d(0).alias("a"), d(1).alias("b"), d(2).alias("c")).select("id", F.format_string("(%d + %d) * %d", "a", "b", "c").alias("prompt"), ((F.col("a") + F.col("b")) * F.col("c")).alias("answer"))


def write_json(df: DataFrame, path: str, array: bool = False) -> None:
    """JSON with characters as they are; ``array``: one indented array for each file, else a line for each row."""
    if not array:
        df.write.mode("overwrite").json(path)
        return
    whole = df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value"))

    def files(rows):
        import pyarrow as pa

        held = None  # the line before: the last one of a file closes the array
        for batch in rows:
            lines = []
            for text in batch.column(0).to_pylist():
                if held is not None:
                    lines.append(held + ",")
                held = text if held is not None else "[" + text
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines)], names=["value"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held + "]"])], names=["value"])

    whole.mapInArrow(files, "value string").write.mode("overwrite").text(path)


def read_split(spark: SparkSession, root: str, name: str, config: str, split: str) -> DataFrame:
    """A split of a configuration of a named data set: {root}/{name}/{config}/{split}*.parquet."""
    return spark.read.option("pathGlobFilter", f"{split}*.parquet").parquet(f"{root}/{name}/{config}")


def append_trajectory(df: DataFrame, path: str, name: str, step: int) -> None:
    """A named dump of a step, appended; several runs of a step each leave their rows."""
    df.withColumn("name", F.lit(name)).withColumn("step", F.lit(step)).write.mode("append").partitionBy("name", "step").parquet(path)


def dump_generations(df: DataFrame, path: str, step: int, columns: Sequence[str] = ()) -> None:
    """Inputs, outputs, scores and those of the further columns that are set in every row, as JSON lines of a step."""
    full = df.agg(*[(F.count(c) == F.count("*")).alias(c) for c in columns]).first() if columns else {}
    keep = [c for c in columns if full[c]]
    write_steps(df.select("input", "output", "score", *keep).withColumn("step", F.lit(step)), path)
