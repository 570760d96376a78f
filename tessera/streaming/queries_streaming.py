"""Queries of the streaming forms (R) in batch, so that SQL can check them; the streaming runs are in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources import files
from tessera.streaming.stateful import controller, curriculum, one_ahead, read_growing, record_scores, run_steps, sessions


@query("r_tumbling_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def tumbling(t):
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return t.events.groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("r_session_window", "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s) SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM g GROUP BY user_id, k")
def session(t):
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e, "ts", "30 minutes", "user_id").withColumn("start", F.col("start").cast("timestamp_ntz"))


def in_files(t, parts: int = 3) -> str:
    """Events as files of a folder, one for each part."""
    root = files.shared_folder(t.spark)
    for i in range(parts):
        t.events.where(F.col("event_id") % parts == i).select("event_id", "user_id", "event_type", "value").coalesce(1).write.mode("append").parquet(f"{root}/in")
    return root


KIND = "event_id long, user_id long, event_type string, value double"


@query("r1_step_loop", "SELECT (event_id % 3)::BIGINT AS part, count(*)::BIGINT AS n FROM events GROUP BY part")
def r1(t):
    root = in_files(t)
    run_steps(read_growing(t.spark, f"{root}/in", KIND), lambda df, step: df.withColumn("step", F.lit(step)).write.mode("append").parquet(f"{root}/out"), f"{root}/state")
    out = t.spark.read.parquet(f"{root}/out")
    return out.groupBy("step").agg(F.first(F.col("event_id") % 3).alias("part"), F.count("*").alias("n")).select("part", "n")


@query("r2_one_step_ahead", "SELECT (event_id % 5)::INT AS step, greatest(event_id % 5 - 1, 0)::INT AS weights, sum(event_id)::BIGINT AS total FROM events GROUP BY ALL")
def r2(t):
    """Five batches of events: each is summed with the weights of before the last update."""
    version = [0]

    def generate(i):
        return i, version[0], t.events.where(F.col("event_id") % 5 == i).agg(F.sum("event_id")).first()[0]

    def update(made):
        version[0] += 1
        return made

    return t.spark.createDataFrame(one_ahead(range(5), generate, update), "step int, weights int, total long")


@query("r3_growing_source", "SELECT event_id FROM events UNION ALL SELECT -event_id - 1 FROM events WHERE event_id % 3 = 0")
def r3(t):
    root = in_files(t)
    step = lambda df, i: df.write.mode("append").parquet(f"{root}/out")
    for more in (None, t.events.where("event_id % 3 = 0")):
        if more is not None:
            more.select((-F.col("event_id") - 1).alias("event_id"), "user_id", "event_type", "value").write.mode("append").parquet(f"{root}/in")
        run_steps(read_growing(t.spark, f"{root}/in", KIND, 100), step, f"{root}/state")
    return t.spark.read.parquet(f"{root}/out").select("event_id")


def in_order(t, columns, parts: int = 4) -> str:
    """Events by their ids as files of a folder, one for each part, the first ids first."""
    root, most = files.shared_folder(t.spark), t.events.agg(F.max("event_id")).first()[0]
    for i in range(parts):
        t.events.where(F.floor(F.col("event_id") * parts / (most + 1)) == i).select(*columns).coalesce(1).write.mode("append").parquet(f"{root}/in")
    return root


def stopped_and_resumed(t, stream, root: str, mode: str = "append"):
    """The rows that a stateful stream gives if it is stopped in its second step and started again from its checkpoint."""

    def keep(df, step):
        if step == 1 and not files.exists(t.spark, f"{root}/failed"):
            files.make_dirs(t.spark, f"{root}/failed")
            raise RuntimeError("lost")
        df.write.mode("overwrite").parquet(f"{root}/out/step={step}")

    for _ in range(2):
        try:
            stream().writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
        except Exception as e:  # noqa: BLE001  the first run ends in its second step
            if "lost" not in str(e):
                raise
    return t.spark.read.parquet(f"{root}/out").drop("step")


@query("r4_accumulated_batches", """WITH k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)
SELECT user_id, (i // 16)::BIGINT AS batch, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS rows FROM k GROUP BY ALL""")
def r4(t):
    """Batches of 16 events of a user from a stream that is stopped in its second step and resumed; what is left comes out when the input ends."""
    from tessera.streaming.stateful import accumulate, end_of_input

    root = in_order(t, ["event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")])
    kind = t.spark.read.parquet(f"{root}/in")
    end_of_input(kind, "ts").coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = lambda: accumulate(read_growing(t.spark, f"{root}/in", kind.schema), "user_id", "event_id", 16, "ts", "365 days")
    out = stopped_and_resumed(t, stream, root)
    return out.select("user_id", "batch", F.array_join(F.col("rows").cast("array<string>"), ",").alias("rows"))


@query("x12_routed_stream")
def x12s(t):
    """Turns (clicks, views, errors) and releases (other events) of users, in seven pools with three servers each that know eight users at most; stopped and resumed."""
    from tessera.streaming.stateful import routed

    root = in_order(t, ["event_id", (F.col("user_id") % 7).alias("pool"), F.col("user_id").cast("string").alias("request"), F.col("event_type").isin("signup", "purchase").alias("ends")])
    schema = t.spark.read.parquet(f"{root}/in").schema
    stream = lambda: routed(read_growing(t.spark, f"{root}/in", schema), "pool", "event_id", "request", "ends", 3, 8)
    return stopped_and_resumed(t, stream, root).select("event_id", "pool", "server")


@query("r5_controller_state", "SELECT event_type, round(0.2 * pow(1 + 0.2 * 4.0 / 1000.0, count(*)), 9) AS coef FROM events GROUP BY event_type")
def r5(t):
    root = in_files(t)
    s = controller(read_growing(t.spark, f"{root}/in", KIND).withColumn("kl", F.lit(0.9)), "event_type", "kl", 4.0, 0.1, 1000.0, 0.2)
    keep = lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{root}/out")
    s.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    out = t.spark.read.parquet(f"{root}/out").groupBy("event_type").agg(F.max_by("coef", "batch").alias("coef"))
    return out.select("event_type", F.round("coef", 9).alias("coef"))


@query("r6_curriculum_update", "SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def r6(t):
    root = in_files(t)
    run_steps(read_growing(t.spark, f"{root}/in", KIND), record_scores(f"{root}/scores", "event_type", "value"), f"{root}/state")
    return curriculum(t.spark, f"{root}/scores", "event_type").select("event_type", F.round("mean", 6).alias("mean"))


@query("r7_rate_limit", "WITH k AS (SELECT event_id, epoch(ts)::DOUBLE AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, user_id FROM events) SELECT event_id, round(max(s - (k - 1) * 6000.0) OVER (PARTITION BY user_id ORDER BY k) + (k - 1) * 6000.0, 3) AS admitted FROM k")
def r7(t):
    """When each event of a user passes a limiter of one request in 6,000 seconds."""
    from tessera.streaming.stateful import throttled

    e = t.events.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return throttled(e, "user_id", "at", "event_id", per_minute=0.01, burst=1.0).select("event_id", F.round("admitted", 3).alias("admitted"))


@query("r8_resumed_steps", "SELECT event_id, 1::BIGINT AS n FROM events")
def r8(t):
    root = in_files(t)

    def fails_once(df, step):
        if step == 1 and not files.exists(t.spark, f"{root}/failed"):
            files.make_dirs(t.spark, f"{root}/failed")
            raise RuntimeError("lost")
        df.write.mode("overwrite").parquet(f"{root}/out/step={step}")

    for _ in range(2):
        try:
            run_steps(read_growing(t.spark, f"{root}/in", KIND), fails_once, f"{root}/state")
        except Exception as e:  # noqa: BLE001  the first run ends in its second step
            if "lost" not in str(e):
                raise
    return t.spark.read.parquet(f"{root}/out").groupBy("event_id").agg(F.count("*").alias("n"))
