"""Queries of sources and sinks that the driver tables can exercise (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.batch import seeded_order
from tessera.plans.registry import query
from tessera.sources import files, io


@query("s1_union_scan", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def s1(t):
    a = t.spark.read.parquet(f"{t.sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return a.unionByName(t.benchmark.select(F.col("item_id").alias("id"), "text"))


@query("s2_nested_key", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE props IS NOT NULL")
def s2(t):
    return t.events.select("event_id", F.from_json("props", "k bigint").alias("p")).select("event_id", "p.k")


@query("s3_conversations", "SELECT conv_id, count(*)::BIGINT AS turns, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def s3(t):
    m = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return m.select("conv_id", F.size("messages").cast("long").alias("turns"), F.array_join("messages.role", ",").alias("roles"))


@query("s4_preferences", "WITH k AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS hi, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id DESC) AS lo FROM events) SELECT user_id, max(event_id) FILTER (WHERE hi = 1) AS chosen, max(event_id) FILTER (WHERE lo = 1) AS rejected FROM k GROUP BY user_id")
def s4(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("value", (-F.col("event_id")).alias("i"))).alias("chosen"), F.min_by("event_id", F.struct("value", (-F.col("event_id")).alias("i"))).alias("rejected"))


@query("s7_json_round_trip", "SELECT event_id, event_type FROM events")
def s7(t):
    one = t.events.select(F.to_json(F.struct("event_id", "event_type")).alias("j"))
    return one.select(F.from_json("j", "event_id bigint, event_type string").alias("x")).select("x.*")


@query("s12_step_mask", "SELECT conv_id, turn, regexp_replace(text, '[0-9]+', '', 'g') AS text FROM conversations")
def s12(t):
    return t.conversations.select("conv_id", "turn", F.regexp_replace("text", "[0-9]+", "").alias("text"))


@query("s13_subtitle_times", "SELECT (event_id * 2.25)::DOUBLE AS start, (event_id * 2.25 + 1.5)::DOUBLE AS end, event_type || chr(10) || 'of ' || user_id AS text FROM events")
def s13(t):
    """Every event as a block of two lines in subtitle files, read back."""
    stamp = lambda s: F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600), F.floor(s / 60) % 60, F.floor(s) % 60, (s * 1000).cast("long") % 1000)
    at, folder = F.col("event_id") * 2.25, f"{files.shared_folder(t.spark)}/subtitles"
    block = F.concat(F.col("event_id").cast("string"), F.lit("\n"), stamp(at), F.lit(" --> "), stamp(at + 1.5), F.lit("\n"), "event_type", F.lit("\nof "), F.col("user_id").cast("string"), F.lit("\n"))
    t.events.repartition(4, "event_id").sortWithinPartitions("event_id").select(block.alias("value")).write.text(folder)
    return io.read_srt(t.spark, folder)


@query("s15_generated_rows")
def s15(t):
    return io.math_source(t.documents.select(F.col("doc_id").alias("id")))


@query("s16_char_count_source")
def s16(t):
    return io.char_count_source(t.documents.select(F.col("doc_id").alias("id")))


@query("s21_sample_table", "SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 25")
def s21(t):
    return t.documents.select("doc_id", seeded_order("doc_id", seed=42).alias("k")).orderBy("k", "doc_id").limit(25).select("doc_id")


@query("s23_flatten", "SELECT event_id AS \"a/id\", event_type AS \"a/b/kind\" FROM events")
def s23(t):
    return io.flatten_struct(t.events.select(F.struct(F.col("event_id").alias("id"), F.struct(F.col("event_type").alias("kind")).alias("b")).alias("a")))


@query("s5_cached_copy", "SELECT n_nationkey, n_name FROM nation")
def s5(t):
    cache = files.shared_folder(t.spark)
    files.cached(t.spark, f"{t.sf_dir}/nation.parquet", cache)
    return t.spark.read.parquet(files.cached(t.spark, f"{t.sf_dir}/nation.parquet", cache)).select("n_nationkey", "n_name")


@query("s6_file_operations", "SELECT * FROM (VALUES ('before', false), ('made', true), ('folder', true), ('copied', true), ('file', true), ('removed', true), ('after', false)) v(step, ok)")
def s6(t):
    root = files.shared_folder(t.spark)
    steps = [("before", files.exists(t.spark, root)), ("made", files.make_dirs(t.spark, root)), ("folder", files.exists(t.spark, root)), ("copied", files.copy(t.spark, f"{t.sf_dir}/region.parquet", f"{root}/region.parquet"))]
    steps += [("file", files.exists(t.spark, f"{root}/region.parquet")), ("removed", files.remove(t.spark, root)), ("after", files.exists(t.spark, root))]
    return t.spark.createDataFrame(steps, "step string, ok boolean")


def _nations_as_json(t) -> str:
    """Nations as a JSON array in a folder for each region (a handful)."""
    root = files.shared_folder(t.spark)
    n = t.nation.groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct(F.col("n_name").alias("video_path"), F.col("n_nationkey").alias("start_time")))).alias("rows"))
    for r in n.toLocalIterator():
        files.write_text(t.spark, f"{root}/n_regionkey={r.n_regionkey}/captions.json", r.rows)
    return root


@query("s8_json_tree", "SELECT n_name AS video_path, n_nationkey AS start_time, 'n_regionkey=' || n_regionkey AS folder FROM nation")
def s8(t):
    tree = io.read_json_tree(t.spark, _nations_as_json(t), "start_time long, video_path string")
    return tree.select("video_path", "start_time", F.element_at(F.split("file", "/"), -2).alias("folder"))


@query("s9_merged_json", "SELECT n_name AS video_path, n_nationkey AS start_time FROM nation ORDER BY ALL")
def s9(t):
    return io.merge_json(t.spark, _nations_as_json(t)).select("video_path", "start_time")


@query("s10_list_scan", "SELECT '/videos/' || n_name || '.mp4' AS path FROM nation")
def s10(t):
    root = files.shared_folder(t.spark)
    line = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("# note"), F.lit("   "), F.concat(F.lit("  /videos/"), "n_name", F.lit(".mp4 ")))).otherwise(F.array(F.concat(F.lit("/videos/"), "n_name", F.lit(".mp4"))))
    t.nation.select(F.explode(line).alias("value")).write.text(root)
    return io.read_list(t.spark, root)


@query("s11_file_index", "SELECT n_regionkey AS name, max(n_nationkey) AS kept FROM (SELECT n_regionkey::VARCHAR AS n_regionkey, 'k=' || n_nationkey AS n_nationkey FROM nation) GROUP BY ALL")
def s11(t):
    root = files.shared_folder(t.spark)
    for n, r in sorted((n, r) for n, r in t.nation.select("n_nationkey", "n_regionkey").toLocalIterator()):  # a handful of files
        files.write_text(t.spark, f"{root}/k={n}/{r}.mp4", "x")
    index = io.index_files(t.spark, root, first=False)
    return index.select("name", F.element_at(F.split("path", "/"), -2).alias("kept"))


@query("s14_config_split", "SELECT n_name, n_regionkey AS region FROM nation WHERE n_nationkey % 2 = 0")
def s14(t):
    """Each region is a configuration with two splits; the test splits of all of them."""
    root, out = files.shared_folder(t.spark), None
    for r in t.region.select("r_regionkey").collect():  # a folder for each
        for split, rest in (("train", 1), ("test", 0)):
            part, made = t.nation.where((F.col("n_regionkey") == r[0]) & (F.col("n_nationkey") % 2 == rest)).select("n_name").coalesce(1), f"{root}/tmp-{r[0]}-{split}"
            part.write.parquet(made)
            found = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(made).first()["path"]
            files.make_dirs(t.spark, f"{root}/nations/{r[0]}")
            files.copy(t.spark, found, f"{root}/nations/{r[0]}/{split}-00000.parquet")
        one = io.read_split(t.spark, root, "nations", str(r[0]), "test").withColumn("region", F.lit(r[0]))
        out = one if out is None else out.unionByName(one)
    return out


@query("s17_parquet_sink", "SELECT event_id, event_type FROM events")
def s17(t):
    root = files.shared_folder(t.spark)
    io.save(t.events.select("event_id", "event_type"), root)
    return io.load(t.spark, root)


@query("s18_json_sink", "SELECT n_nationkey AS id, n_name || ' é 中' AS name FROM nation")
def s18(t):
    root = files.shared_folder(t.spark)
    io.write_json(t.nation.select(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit(" é 中")).alias("name")), root, array=True)
    return io.read_json_array(t.spark, root, "id int, name string")


@query("s20_generation_dump", "SELECT doc_id % 3 AS step, count(*)::BIGINT AS n, min(coalesce(lang, '-') || doc_id) AS first, 'input,output,score,step,tag' AS columns FROM documents GROUP BY ALL")
def s20(t):
    root = files.shared_folder(t.spark)
    d = t.documents.select(F.concat(F.coalesce("lang", F.lit("-")), F.col("doc_id").cast("string")).alias("input"), F.col("text").alias("output"), F.col("n_chars").cast("double").alias("score"), F.lit("x").alias("tag"), F.when(F.col("doc_id") % 7 != 0, 1).alias("rare"), (F.col("doc_id") % 3).alias("s"))
    for step in range(3):
        io.dump_generations(d.where(F.col("s") == step), root, step, ["tag", "rare"])
    out = t.spark.read.json(root)
    return out.groupBy(F.col("step").cast("long").alias("step")).agg(F.count("*").alias("n"), F.min("input").alias("first")).withColumn("columns", F.lit(",".join(sorted(out.columns))))


@query("s22_metric_sink", "SELECT (user_id % 3)::INT AS step, unnest(['mean/' || event_type, 'n/' || event_type]) AS name, round(unnest([avg(value), count(*)]), 6)::DOUBLE AS value FROM events GROUP BY user_id % 3, event_type")
def s22(t):
    """Three steps of metrics of the events, logged one after the other."""
    sink, seen = io.MetricSink(t.spark, root := files.shared_folder(t.spark), lambda rows: seen.extend(rows)), []
    sums = t.events.groupBy((F.col("user_id") % 3).alias("step"), "event_type").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    for step in range(3):
        sink.log({f"{k}/{r['event_type']}": r[k] for r in sums.where(F.col("step") == step).collect() for k in ("mean", "n")}, step)  # a row for each kind of event
    return t.spark.read.schema("step int, name string, value double").parquet(root).withColumn("value", F.round("value", 6))


@query("s24_saved_batch", "SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY user_id")
def s24(t):
    root = files.shared_folder(t.spark)
    io.save(t.events.groupBy("user_id").agg(F.collect_list("event_id").alias("ids")), root)
    return io.load(t.spark, root).select("user_id", F.size("ids").cast("long").alias("n"))


@query("s25_trajectory", "SELECT 'actor' AS name, n_regionkey AS step, count(*)::BIGINT AS n FROM nation GROUP BY ALL")
def s25(t):
    root = files.shared_folder(t.spark)
    for step in sorted(r[0] for r in t.region.select("r_regionkey").collect()):
        io.append_trajectory(t.nation.where(F.col("n_regionkey") == step), root, "actor", step)
    return t.spark.read.parquet(root).groupBy("name", F.col("step").cast("long").alias("step")).agg(F.count("*").alias("n"))
