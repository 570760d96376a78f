"""Queries of the curation stages (L1-L5, L7-L9) with stand-in clients, on events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import video as V
from tessera.plans.registry import query

#: Documents as videos: a name, a length in seconds, and a caption.
CAP = "cap AS (SELECT user_id AS video, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::DOUBLE AS start, event_type AS caption, event_id FROM events)"


def captions(t):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return t.events.select(F.col("user_id").alias("video"), place.cast("double").alias("start"), (place + 1).cast("double").alias("end"), F.col("event_type").alias("caption"), "event_id")


@query("l1_scenes", "SELECT doc_id, round(CASE WHEN doc_id % 2 = 0 THEN i * 5.0 ELSE i * n_chars / 4.0 END, 6)::DOUBLE AS start, round(CASE WHEN doc_id % 2 = 0 THEN i * 5.0 + 5 WHEN i = 3 THEN n_chars - 1 ELSE (i + 1) * n_chars / 4.0 END, 6)::DOUBLE AS end FROM documents, range(4) r(i) WHERE n_chars > 0 AND (doc_id % 2 = 1 OR i < 2)")
def l1(t):
    out = V.detect_scenes(t.documents, "doc_id", "n_chars", lambda k, n: [(0, 5), (5, 10)] if k % 2 == 0 else [], 4)
    return out.select("doc_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("l2_clip_captions", "WITH s AS (SELECT p_partkey, p_size::DOUBLE AS e FROM part), c AS (SELECT p_partkey, unnest(range(0, greatest(floor(e)::BIGINT, 1), 10))::DOUBLE AS start, e FROM s WHERE e > 10 UNION ALL SELECT p_partkey, 0, e FROM s WHERE e <= 10) SELECT p_partkey, start, 'clip at ' || printf('%.1f', start) AS caption FROM c WHERE start <> 20")
def l2(t):
    def client(prompt):
        start = prompt.split()[1].split("-")[0]
        if start == "20.0":
            raise RuntimeError("no answer")
        return f"clip at {start}"

    seg = t.part.select("p_partkey", F.lit(0.0).alias("start"), F.col("p_size").cast("double").alias("end"))
    return V.clip_captions(seg, "p_partkey", client).select("p_partkey", "start", "caption")


_RUNS = f"WITH {CAP}, n AS (SELECT *, CASE WHEN caption = lag(caption) OVER w THEN 0 ELSE 1 END AS nw FROM cap WINDOW w AS (PARTITION BY video ORDER BY start)), e AS (SELECT *, sum(nw) OVER (PARTITION BY video ORDER BY start) - 1 AS event FROM n)"


@query("l3_merged_events", _RUNS + " SELECT video, event::BIGINT AS event, string_agg(caption, ',' ORDER BY start) AS captions FROM e GROUP BY ALL")
def l3(t):
    yes = lambda prompt: "Yes." if len(set(prompt.split("\n"))) == 1 else "No."
    return V.merge_events(captions(t), "video", yes).select("video", "event", F.array_join("captions", ",").alias("captions"))


@query("l4_merged_captions", f"WITH {CAP} SELECT video, string_agg(caption, '' ORDER BY start) AS caption FROM cap GROUP BY video")
def l4(t):
    events = captions(t).groupBy("video").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "caption"))), lambda e: e["caption"]).alias("captions"))
    return V.merge_captions(events, ["video"], "captions", lambda prompt: prompt.replace("\n", ""))


@query("l5_questions", f"WITH {CAP}, g AS (SELECT video, floor(start / 6)::BIGINT AS group_id, string_agg(caption, chr(10) ORDER BY start) AS merged, count(*) AS n FROM cap WHERE video % 3 <> 0 GROUP BY ALL) SELECT video, group_id, 'what?' AS question, split_part(merged, chr(10), 1) AS answer, round((n + 4) / 1000 * 0.5, 9)::DOUBLE AS cost FROM g WHERE n > 1")
def l5(t):
    def client(text):
        lines = text.split("\n")
        return '{"question": "%s", "answer": "%s"}' % ("what?" if len(lines) > 1 else "", lines[0])

    done = t.events.where("user_id % 3 = 0").select(F.col("user_id").alias("video")).distinct()
    return V.generate_questions(captions(t), "video", client, 6, 0.5, done)


@query("l7_selected_questions", f"WITH {CAP}, k AS (SELECT video, event_id, row_number() OVER (PARTITION BY video ORDER BY event_id) AS a, count(*) OVER (PARTITION BY video) AS n FROM cap WHERE video % 4 <> 0) SELECT video, event_id, CASE WHEN a = n THEN 1 ELSE 2 END::BIGINT AS rank FROM k WHERE a = n OR a = 1")
def l7(t):
    def client(prompt):  # the last, then the first; an id that is not in the list; the last again
        ids = [line.split(":")[0] for line in prompt.split("\n")[1:]]
        return f"[{ids[-1]}, {ids[0]}, 999999999, {ids[-1]}]"

    q = captions(t).select("video", "event_id", F.col("caption").alias("question"))
    s = q.select("video").distinct().withColumn("summary", F.when(F.col("video") % 4 == 0, "").otherwise("seen"))
    out = V.select_questions(q, s, "video", "event_id", client)
    return out.select("video", "event_id", F.col("rank").cast("long").alias("rank"))


def viewed(t):
    q = t.customer.select("c_custkey", F.col("c_name").alias("video"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise("what?").alias("question"), F.col("c_mktsegment").alias("answer"))
    index = t.customer.where("c_custkey % 3 <> 0").select(F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, ".mp4").otherwise("")).alias("name"), F.concat(F.lit("/v/"), "c_name").alias("path"))

    def client(prompt):
        key = int(prompt.split("\n")[0].rpartition("#")[2])
        return {0: "no idea", 1: "score: 90", 2: "0.5", 3: "0.85"}[key % 4]

    return V.filter_by_view(q, index, "video", client)


@query("l8_viewed_questions", "SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 0.9 ELSE 0.85 END::DOUBLE AS score FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 4 IN (1, 3)")
def l8(t):
    return viewed(t)[0].select("c_custkey", "score")


@query("l8_funnel", "SELECT count(*)::BIGINT AS valid, count(*) FILTER (c_custkey % 3 <> 0)::BIGINT AS found, count(*) FILTER (c_custkey % 3 <> 0 AND c_custkey % 4 <> 0)::BIGINT AS evaluated, count(*) FILTER (c_custkey % 3 <> 0 AND c_custkey % 4 IN (1, 3))::BIGINT AS passed FROM customer WHERE c_custkey % 5 <> 0")
def l8_funnel(t):
    return viewed(t)[1]


@query("l9_reasoning_traces", "SELECT doc_id, 'rounds 1' AS think, '0,' || (greatest(n, 1) - 1) // 3 || ',' || (greatest(n, 1) - 1) * 2 // 3 || ',' || (greatest(n, 1) - 1) AS frames FROM (SELECT doc_id, n_chars % 800 AS n FROM documents) WHERE doc_id % 2 = 1")
def l9(t):
    d = t.documents.select("doc_id", F.concat("lang", F.col("doc_id").cast("string")).alias("name"), (F.col("n_chars") % 800).cast("double").alias("seconds"), F.lit("what?").alias("question"), F.when(F.col("doc_id") % 2 == 1, "yes").otherwise("").alias("answer"))
    out = V.reasoning_traces(d.withColumn("name", F.coalesce("name", F.lit("none"))), "name", "seconds", lambda p: f"<think> {p.split(chr(10))[-1]} </think> so yes", 4)
    return out.select("doc_id", "think", F.array_join(F.col("frames").cast("array<string>"), ",").alias("frames"))
