"""Queries of curation, interval joins and balanced partitions (J2-J10, W17-W22, F73-F74, S19, S26, T2, X4-X9, L) on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import balance as B
from tessera.operators import curation as C
from tessera.plans.registry import query

SEG = "seg AS (SELECT user_id, event_id, epoch(ts)::DOUBLE AS a, lead(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)::DOUBLE AS b FROM events)"


def seg(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t.events.select("user_id", "event_id", sec.alias("a"), F.lead(sec).over(w).alias("b"))


@query("f73_split_even", "SELECT c_custkey, k::INT AS part, round(k * (c_acctbal / 4), 6) AS start, round(CASE WHEN k = 3 THEN c_acctbal - 1 ELSE (k + 1) * (c_acctbal / 4) END, 6) AS end FROM customer, (SELECT unnest([0,1,2,3]) AS k) WHERE c_acctbal > 0")
def f73(t):
    out = C.split_even(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", 4)
    return out.select("c_custkey", "part", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("f74_split_windows", "WITH p AS (SELECT p_partkey, p_size::DOUBLE AS e FROM part) SELECT p_partkey, unnest(range(0, greatest(floor(e)::BIGINT, 1), 10))::DOUBLE AS a FROM p WHERE e > 10 UNION ALL SELECT p_partkey, 0 FROM p WHERE e <= 10")
def f74(t):
    p = t.part.select("p_partkey", F.lit(0.0).alias("a"), F.col("p_size").cast("double").alias("b"))
    return C.split_windows(p, "a", "b").select("p_partkey", "a")


_SIZE = "CASE WHEN n < 8 THEN n WHEN n <= 16 THEN 4 ELSE 8 END"


@query("w17_adaptive_groups", f"WITH c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT event_id, floor((k - 1) / ({_SIZE}))::BIGINT AS group_id FROM c")
def w17(t):
    return C.group_captions(t.events, "user_id", ["ts", "event_id"]).select("event_id", "group_id")


@query("w18_fixed_groups", "WITH c AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT user_id, ((k - 1) // 30)::BIGINT AS group_id, string_agg(event_type, chr(10) ORDER BY us, event_id) AS merged, min(us)::BIGINT AS start, max(us)::BIGINT AS end, count(*)::BIGINT AS segments FROM c GROUP BY ALL")
def w18(t):
    e = t.events.select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return C.merge_groups(C.group_captions(e, "user_id", ["us", "event_id"], 30), ["user_id", "group_id"], ["us", "event_id"], "event_type", "us", "us")


@query("w19_session_merge", f"WITH {SEG}, o AS (SELECT user_id, a, least(b, a + 600) AS b FROM seg WHERE b IS NOT NULL), n AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 60 THEN 0 ELSE 1 END AS nw FROM o), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM n) SELECT user_id, session::BIGINT AS session, round(min(a), 3) AS a, round(max(b), 3) AS b, count(*)::BIGINT AS events FROM s GROUP BY ALL")
def w19(t):
    s = seg(t).where("b is not null").select("user_id", "a", F.least("b", F.col("a") + 600).alias("b"))
    return C.session_merge(s, "user_id", "a", "b", 60.0).select("user_id", F.col("session").cast("long").alias("session"), F.round("a", 3).alias("a"), F.round("b", 3).alias("b"), "events")


@query("w19_adjacent_merge", """WITH n AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER w)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS event FROM n)
SELECT user_id, event::BIGINT AS event, string_agg(event_type, ',' ORDER BY event_id) AS captions FROM g GROUP BY ALL""")
def w19j(t):
    """With equal captions as the judge, the merge gives runs of equal neighbours."""
    return C.merge_adjacent(t.events, "user_id", "event_id", "event_type", lambda a, b: a == b).withColumn("captions", F.array_join("captions", ","))


@query("w20_tree_merge", "SELECT conv_id, string_agg(role, '+' ORDER BY turn) AS merged FROM conversations GROUP BY conv_id")
def w20(t):
    return C.tree_merge(t.conversations, "conv_id", "turn", "role")


@query("w21_tool_mask", "WITH i AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS nw FROM conversations) SELECT conv_id, turn, sum(nw) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS block, (role <> 'user')::INT AS m FROM i")
def w21(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    new = F.coalesce((F.col("role") != F.lag("role").over(w)).cast("int"), F.lit(1))
    x = t.conversations.withColumn("nw", new)
    return x.select("conv_id", "turn", F.sum("nw").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("block"), (F.col("role") != "user").cast("int").alias("m"))


@query("w22_error_fill", "SELECT l_orderkey, k::BIGINT AS k, CASE WHEN bool_or(bad) OVER (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) THEN -4 ELSE l_linenumber END AS res FROM (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS bad, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS k FROM lineitem)")
def w22(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    bad = F.bool_or(F.col("l_returnflag") == "R").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return t.lineitem.select("l_orderkey", F.row_number().over(w).cast("long").alias("k"), F.when(bad, -4).otherwise(F.col("l_linenumber")).alias("res"))


@query("j4_summary_lookup", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name <> ''")
def j4(t):
    return t.orders.join(t.customer.where("c_name <> ''"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("j5_fallback_lookup", "WITH i AS (SELECT c_name AS n, min(c_custkey) AS p FROM customer GROUP BY c_name), d AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_name || '.mp4' ELSE c_name || '.x' END AS name FROM customer) SELECT c_custkey, coalesce(a.p, b.p, c.p) AS path FROM d LEFT JOIN i a ON a.n = name LEFT JOIN i b ON b.n = name || '.mp4' LEFT JOIN i c ON c.n = regexp_replace(name, '\\.mp4$', '')")
def j5(t):
    index = t.customer.groupBy("c_name").agg(F.min("c_custkey").alias("p"))
    k = F.col("c_custkey") % 3
    d = t.customer.select("c_custkey", F.when(k == 0, F.col("c_name")).when(k == 1, F.concat("c_name", F.lit(".mp4"))).otherwise(F.concat("c_name", F.lit(".x"))).alias("name"))
    return C.fallback_lookup(d, index, "name").select("c_custkey", "path")


@query("j6_selected_pairs", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN (SELECT o_orderkey, o_custkey % 7 + 1 AS k FROM orders) ON l_orderkey = o_orderkey AND l_linenumber = k")
def j6(t):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 7 + 1).cast("int").alias("l_linenumber"))
    return t.lineitem.join(o, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("j7_range_join", f"WITH {SEG}, p AS (SELECT user_id, epoch(ts)::DOUBLE + 30 AS f, event_id AS pid FROM events WHERE event_type = 'click') SELECT DISTINCT pid, event_id FROM p JOIN seg USING (user_id) WHERE f >= a AND f < b")
def j7(t):
    p = t.events.where("event_type = 'click'").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + 30).alias("f"), F.col("event_id").alias("pid"))
    return C.range_join(p, seg(t).where("b is not null"), "f", "a", "b", "user_id", 86400.0).select("pid", "event_id").distinct()


@query("j8_covered_points", f"WITH {SEG}, p AS (SELECT user_id, epoch(ts)::DOUBLE + 45 AS f, event_id AS pid FROM events) SELECT pid FROM p WHERE EXISTS (SELECT 1 FROM seg WHERE seg.user_id = p.user_id AND f > a AND b IS NOT NULL AND f < least(b, a + 3600))")
def j8(t):
    p = t.events.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + 45).alias("f"), F.col("event_id").alias("pid"))
    s = seg(t).where("b is not null").withColumn("b", F.least("b", F.col("a") + 3600))
    return C.covered_points(p, s, "f", "a", "b", "user_id", 3600.0).select("pid")


@query("j9_interval_iou", "SELECT p_partkey, round(greatest(least(p_size + 10, 40) - greatest(p_size, 20), 0) / (greatest(p_size + 10, 40) - least(p_size, 20)), 6)::DOUBLE AS iou FROM part")
def j9(t):
    from tessera.functions.text import interval_iou

    s = F.col("p_size").cast("double")
    return t.part.select("p_partkey", F.round(interval_iou(s, s + 10, F.lit(20.0), F.lit(40.0)), 6).alias("iou"))


@query("j10_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j10(t):
    return C.unprocessed(t.documents, t.labels, "doc_id").select("doc_id")


@query("s26_skip_done", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey)")
def s26(t):
    return C.unprocessed(t.orders, t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").select("o_orderkey")


@query("s19_teams", "WITH k AS (SELECT source, ((row_number() OVER (ORDER BY source)) - 1) % 4 AS team FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id, team::BIGINT AS team FROM documents JOIN k USING (source)")
def s19(t):
    return C.teams(t.documents, "source", 4).select("doc_id", "team")


@query("p16_qa_validity", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority <> '' AND l_shipdate > o_orderdate")
def p16(t):
    x = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.where("o_orderpriority <> '' and l_shipdate > o_orderdate").select("l_orderkey", "l_linenumber", "l_partkey")


@query("p18_coalesced_fields", "SELECT doc_id, coalesce(toxic, quality, -1) AS value FROM documents LEFT JOIN labels USING (doc_id)")
def p18(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("toxic", "quality", F.lit(-1)).alias("value"))


@query("p24_selected_rank", "WITH s AS (SELECT user_id, list(event_id ORDER BY value DESC, event_id)[1:3] AS ids FROM events GROUP BY user_id) SELECT event_id, i::BIGINT AS rank FROM (SELECT unnest(ids) AS event_id, unnest(range(1, len(ids) + 1)) AS i FROM s)")
def p24(t):
    s = t.events.groupBy("user_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), "event_id"))), 1, 3), lambda e: e["event_id"]).alias("ids"))
    return C.attach_rank(t.events, s, "user_id", "ids", "event_id").select("event_id", F.col("rank").cast("long").alias("rank"))


@query("p25_view_filter", "SELECT doc_id, n_chars FROM documents WHERE contains(text, 'tion') ORDER BY n_chars DESC, doc_id")
def p25(t):
    return t.documents.where(F.contains("text", F.lit("tion"))).orderBy(F.desc("n_chars"), "doc_id").select("doc_id", "n_chars")


@query("x7_microbatch_count", "SELECT source, (ceil(greatest(least(count(*), ceil(sum(n_chars) / 20000.0)), 1) / 2) * 2)::BIGINT AS micro_batches FROM documents GROUP BY source")
def x7(t):
    return B.microbatch_count(t.documents, "source", "n_chars", 20000, multiple=2)
