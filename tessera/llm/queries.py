"""The operators as registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import collocations, decontaminate, ngram_join, revisit, substring


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))[0].drop("row_key")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.substring import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffix import dedup_bytes

    return dedup_bytes(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import revisit as R

    out = R.resolve_revisits(R.captures_of_pages(table(spark, sf_dir, "pages")))
    return out.withColumn("headers", R.header_text(out["headers"]))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.tokencount import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"), target_entropy=0.97, max_repeats=4.0)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op11_keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of an upsert of ``client_changes`` into a part of ``clients``: one row for each file that is left."""
    from tessera.llm.upsert import KeyedFiles, crc, latest_changes

    clients, changes = table(spark, sf_dir, "clients"), table(spark, sf_dir, "client_changes")
    files = KeyedFiles(spark, "client_id", 1 + clients.count() // 700).start(clients.where(crc(F.col("client_id")) % 7 > 3))
    starting = files.scratch.write(files.files().select("path"), "starting")
    columns = ["source", "segment", "city", "balance"]
    latest = latest_changes(changes.select("client_id", "seq", "change_id", "op", *columns), "client_id", ["seq", "change_id"])
    h, change = crc(F.col("home.first")) % 12, F.col("change")
    gone = F.coalesce(change["op"] == "D", F.lit(False)) | F.coalesce(crc(change["change_id"]) % 8 < h, F.lit(False))
    decided = files.route(latest).where(h <= 7)
    files.apply(decided.select("id", F.struct(gone.alias("gone"), *[change[c].alias(c) for c in columns]).alias("change"), "home"), columns)
    row = F.col("row")
    text = F.concat(*[x for c in columns[:3] for x in (F.lit("|"), F.coalesce(row[c], F.lit("")))][1:])
    digest = files.rows(index=True).groupBy("path").agg(
        F.min("id").alias("first_id"),
        F.count("*").alias("n_rows"),
        F.coalesce(F.sum(F.floor(100 * row["balance"] + 0.5).cast("long")), F.lit(0)).cast("long").alias("cents"),
        F.sum(F.crc32(text.cast("binary"))).alias("rows_crc"),
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "id"))), lambda x: x["id"].cast("string")), ","), 256).alias("ids_sha256"),
    )
    new = starting.withColumn("old", F.lit(True))
    return digest.join(files.files().select("path", F.col("names").alias("columns")), "path").join(new, "path", "left").select("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", "columns", "path", F.col("old").isNull().alias("rewritten"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are those of the base spans; ``spans`` holds them and those that anchors add."""
    from tessera.llm import pii

    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.joined_spans(F.col("base")), 256).alias("base_sha256"), pii.joined_spans(F.concat("base", "added")).alias("spans"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"), longest=3, least=10, contained_percent=50, top=2000)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_substring_dedup, op3_toxicity, op4_suffix_array_dedup, op5_quality_classifier, op6_warc_revisits, op7_token_counts, op8_source_mixing, op9_ngram_join, op10_quality_rules, op11_keyed_upsert, op12_personal_data, op13_collocations)}
ORACLE_SQL: dict[str, str] = {"op1_decontamination": decontaminate.ORACLE, "op2_substring_dedup": substring.ORACLE, "op6_warc_revisits": revisit.ORACLE, "op9_ngram_join": ngram_join.ORACLE, "op13_collocations": collocations.ORACLE}
