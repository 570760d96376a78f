"""A training-data pipeline of five corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents.  All stages but the last give
the columns of ``documents``; the last gives the passes of the mixed corpus.

Null text is text without words; rows with a null doc_id are near duplicates of none;
further columns, whatever their names and kinds, pass all stages but the last as they
are; a table without rows gives no rows in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import scratch as S
from tessera.llm.decontaminate import decontaminate, text_key
from tessera.llm.mixing import mix_sources
from tessera.llm.ngram_join import ngram_components
from tessera.llm.quality import QualityClassifier
from tessera.llm.substring import dedup_substrings

#: Documents with a lower quality score go.
REJECT_BELOW = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return QualityClassifier().fit(docs, labels).keep(docs, REJECT_BELOW)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id; of rows that repeat doc_id and text one. Rows with a null doc_id stay."""
    scratch = S.Scratch(spark)
    table = scratch.write(ngram_components(docs, row_key=True).where("doc_id is not null").select("row_key", "doc_id", "group"), "components")
    chosen = table.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "row_key")).alias("x")).select("group", F.col("x.row_key").alias("stays"))
    gone = table.join(S.small(scratch.write(chosen, "chosen")), "group").where("row_key <> stays").select("row_key").distinct()
    repeated = table.groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").select("row_key")
    gone, repeated = S.small(scratch.write(gone, "gone")), S.small(scratch.write(repeated, "repeated"))
    stay = docs.select(text_key().alias("row_key"), S.whole_row(docs).alias("row")).join(gone, "row_key", "left_anti")
    single = stay.join(repeated, "row_key", "left_anti").select("row")
    least = stay.join(repeated, "row_key", "left_semi").groupBy("row_key").agg(F.min_by("row", F.md5(F.to_json("row").cast("binary"))).alias("row")).select("row")
    return single.unionAll(least).select(S.columns_of("row", docs))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without words of passages that stand in an earlier document; documents of which nothing is left go."""
    out = dedup_substrings(docs, keep_rows=True).where("n_removed = 0 or n_removed < n_words").select("kept", "row", F.col("n_removed") > 0)
    out = out.toDF("kept", "row", "cut")
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[F.when(F.col("cut"), new[c].cast(docs.schema[c].dataType)).otherwise(old).alias(c) if c in new else old for c, old in zip(docs.columns, S.columns_of("row", docs))])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark passage."""
    verdicts, _ = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = S.small(S.Scratch(spark).write(verdicts.where("contaminated").select("row_key").distinct(), "leaks"))
    keyed = docs.select(text_key().alias("row_key"), S.whole_row(docs).alias("row"))
    return keyed.join(leaks, "row_key", "left_anti").select(S.columns_of("row", docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The passes of the mixed corpus: doc_id, source, n_tokens, epoch, block, mix_order, weight."""
    return mix_sources(docs, target_entropy=0.97, max_repeats=4.0)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
]

#: SQL cannot express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), S.Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
