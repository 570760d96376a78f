"""Queries of evaluation and training metrics (A, J3, J14, T6, T8) on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators.queries_rollout import EV, TOK, ev, r6, tok
from tessera.plans.registry import query


@query("a1_eval_by_source", "WITH c AS (SELECT conv_id, role, avg(length(text)) AS m FROM conversations GROUP BY ALL) SELECT role AS source, round(avg(m), 6) AS score FROM c GROUP BY role")
def a1(t):
    rows = t.conversations.groupBy("conv_id", F.col("role").alias("source")).agg(F.collect_list(F.length("text").cast("double")).alias("scores"))
    return r6(M.eval_by_source(rows, "source", "scores"), "score")


_NAMED = "CASE event_type WHEN 'click' THEN 'len/max' WHEN 'view' THEN 'len/min' ELSE event_type END"


@query("a2_reduce_metrics", f"WITH m AS (SELECT {_NAMED} AS name, value FROM events) SELECT name, round(CASE WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE avg(value) END, 6) AS value FROM m GROUP BY name")
def a2(t):
    return r6(M.reduce_metrics(t.events.select(F.expr(_NAMED).alias("name"), "value")), "value")


@query("a3_batch_metrics", f"WITH {TOK}, q AS (SELECT row_id, sum(r) AS score, count(*) FILTER (WHERE mask) AS len FROM tok GROUP BY row_id) SELECT round(avg(score), 6) AS score_mean, round(max(score), 6) AS score_max, round(min(score), 6) AS score_min, round(avg(len), 6) AS len_mean, max(len)::BIGINT AS len_max, min(len)::BIGINT AS len_min, round(avg((len >= 6)::INT), 6) AS clip_ratio FROM q")
def a3(t):
    q = tok(t).groupBy("row_id").agg(F.sum("r").alias("score"), F.count_if("mask").alias("len"))
    return r6(q.agg(*M.summary(F.col("score"), "score"), *M.summary(F.col("len"), "len"), F.avg((F.col("len") >= 6).cast("int")).alias("clip_ratio")), "score_mean", "score_max", "score_min", "len_mean", "clip_ratio")


@query("a4_explained_variance", f"WITH {TOK} SELECT round(1 - var_samp(r - v) / (var_samp(r) + 1e-5), 6) AS explained FROM tok WHERE mask")
def a4(t):
    return r6(tok(t).where("mask").agg(M.explained_variance("r", "v").alias("explained")), "explained")


@query("a5_valid_only", "WITH x AS (SELECT coalesce(toxic, -1)::DOUBLE AS s FROM documents LEFT JOIN labels USING (doc_id)) SELECT round(avg(s) FILTER (WHERE s >= 0), 6) AS acc_mean, max(s) FILTER (WHERE s >= 0) AS acc_max, min(s) FILTER (WHERE s >= 0) AS acc_min, count(*) FILTER (WHERE s >= 0)::BIGINT AS acc_valid, count(*)::BIGINT AS acc_total FROM x")
def a5(t):
    x = t.documents.join(t.labels, "doc_id", "left").select(F.coalesce("toxic", F.lit(-1)).cast("double").alias("s"))
    return r6(x.agg(*M.valid_only("s", "acc")), "acc_mean")


@query("a6_timing_per_token", f"WITH {TOK} SELECT round(500.0 / count(*) FILTER (WHERE mask), 9) AS gen, round(300.0 / count(*), 9) AS ref FROM tok")
def a6(t):
    return tok(t).agg(F.round(500.0 / F.count_if("mask"), 9).alias("gen"), F.round(300.0 / F.count("*"), 9).alias("ref"))


@query("a7_throughput", "SELECT sum(n_chars)::BIGINT AS tokens, round(sum(n_chars) / (2.0 * 8), 6) AS throughput FROM documents")
def a7(t):
    return t.documents.agg(F.sum("n_chars").alias("tokens"), F.round(F.sum("n_chars") / (2.0 * 8), 6).alias("throughput"))


@query("a8_expected_best", f"WITH {EV}, k AS (SELECT uid, s, row_number() OVER (PARTITION BY uid ORDER BY s) AS k, count(*) OVER (PARTITION BY uid) AS n FROM ev) SELECT uid, round(sum((pow(k / n, 4) - pow((k - 1) / n, 4)) * s), 6) AS value FROM k GROUP BY uid")
def a8(t):
    return r6(M.expected_extreme(ev(t), ["uid"], "s", 4), "value")


@query("a8_bootstrap")
def a8b(t):
    return M.bootstrap(ev(t), "uid", "s", 4, draws=200)


@query("a9_majority_value", f"WITH {EV}, v AS (SELECT uid, event_type, count(*) AS n, min(id) AS fst, arg_min(s, id) AS value FROM ev GROUP BY ALL) SELECT uid, value FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, fst) AS k FROM v) WHERE k = 1")
def a9(t):
    return M.majority_value(ev(t), ["uid"], "event_type", "s", "id")


_LADDER = f"""WITH {EV}, v AS (SELECT event_type AS source, uid, unnest(['s', 'len']) AS variable, unnest([s, len::DOUBLE]) AS x FROM ev), g AS (SELECT * FROM v WHERE x IS NOT NULL),
r AS (SELECT *, count(*) OVER w AS m, row_number() OVER (w ORDER BY x) AS up, row_number() OVER (w ORDER BY x DESC) AS down FROM g WINDOW w AS (PARTITION BY source, uid, variable)),
n AS (SELECT source, uid, variable, m, unnest(list_append(list_filter([2, 4, 8, 16, 32, 64, 128, 256, 512, 1024], lambda i: i < m), m)) AS n FROM (SELECT DISTINCT source, uid, variable, m FROM r) WHERE m > 1),
d AS (SELECT source, uid, variable, n, sum((pow(up / m, n) - pow((up - 1) / m, n)) * x) AS b1, sum((pow(up / m, n) - pow((up - 1) / m, n)) * x * x) AS b2, sum((pow(down / m, n) - pow((down - 1) / m, n)) * x) AS w1, sum((pow(down / m, n) - pow((down - 1) / m, n)) * x * x) AS w2 FROM r JOIN n USING (source, uid, variable, m) GROUP BY ALL),
p AS (SELECT source, uid, variable, m, avg(x) AS mean, stddev_pop(x) AS std FROM r GROUP BY ALL),
a AS (SELECT source, variable, 'mean@' || m AS metric, mean AS value FROM p UNION ALL SELECT source, variable, 'std@' || m, std FROM p WHERE m > 1
UNION ALL SELECT source, variable, 'best@' || n || '/mean', b1 FROM d UNION ALL SELECT source, variable, 'best@' || n || '/std', sqrt(greatest(b2 - b1 * b1, 0)) FROM d
UNION ALL SELECT source, variable, 'worst@' || n || '/mean', w1 FROM d UNION ALL SELECT source, variable, 'worst@' || n || '/std', sqrt(greatest(w2 - w1 * w1, 0)) FROM d)
SELECT source, variable, metric, round(avg(value), 4) AS value FROM a GROUP BY ALL"""


def _samples(t):
    return ev(t).withColumnRenamed("event_type", "source")


@query("a10_validation_metrics", _LADDER)
def a10(t):
    return M.validation_metrics(_samples(t), "source", "uid", ["s", "len"]).withColumn("value", F.round("value", 4))


# every sequence of 2 and of 4 draws of a group's votes, by the chances of the votes; the vote first drawn wins a tie
_DRAWS = f"""WITH {EV}, v AS (SELECT uid, event_type AS vote, count(*) AS c, avg(s) AS m1, avg(s * s) AS m2 FROM ev GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY uid) AS p FROM v),
two AS (SELECT a.uid, 2 AS n, a.p * b.p AS p, [a.vote, b.vote] AS d FROM p a JOIN p b USING (uid)),
four AS (SELECT x.uid, 4 AS n, x.p * y.p AS p, list_concat(x.d, y.d) AS d FROM two x JOIN two y USING (uid)),
q AS (SELECT uid, n, p, d, row_number() OVER () AS i FROM (SELECT * FROM two UNION ALL SELECT * FROM four)),
s AS (SELECT uid, n, p, i, d, unnest(d) AS vote FROM q),
w AS (SELECT uid, n, i, any_value(p) AS p, vote, count(*) AS c, any_value(list_position(d, vote)) AS o FROM s GROUP BY uid, n, i, vote),
best AS (SELECT uid, n, i, p, arg_max(vote, c * 10 - o) AS vote FROM w GROUP BY uid, n, i, p),
e AS (SELECT b.uid, b.n, sum(b.p * v.m1) AS mean, sum(b.p * v.m2) AS second FROM best b JOIN v ON v.uid = b.uid AND v.vote = b.vote GROUP BY ALL)
SELECT uid, n, round(mean, 5) AS mean, round(sqrt(greatest(second - mean * mean, 0)), 5) AS std FROM e"""


@query("a10_majority", _DRAWS)
def a10_majority(t):
    found = M.majority_moments(ev(t), ["uid"], "event_type", "s", F.array(F.lit(2), F.lit(4)))
    return found.select("uid", "n", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query("a10_ladder_with_votes")
def a10_ladder(t):
    """The whole ladder of each user's events, with the majority of event types."""
    return M.validation_metrics(ev(t).withColumn("source", F.pmod("uid", F.lit(5))), "source", "uid", ["s"], vote="event_type")


@query("a11_metric_names", "SELECT event_type AS name, CASE WHEN event_type = 'click' THEN 'val-core/' ELSE 'val-aux/' END || event_type || '/mean@' || max(n) AS metric FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def a11(t):
    n = t.events.groupBy("event_type", "user_id").count().groupBy(F.col("event_type").alias("name")).agg(F.max("count").alias("n"))
    return n.select("name", F.concat(F.when(F.col("name") == "click", "val-core/").otherwise("val-aux/"), "name", F.lit("/mean@"), F.col("n").cast("string")).alias("metric"))


@query("a15_masked_mean_exact", f"WITH {TOK} SELECT round(sum(r) FILTER (WHERE mask) / count(*) FILTER (WHERE mask), 6) AS mean FROM tok")
def a15(t):
    return tok(t).agg(F.round(F.sum(F.when(F.col("mask"), F.col("r"))) / F.count_if("mask"), 6).alias("mean"))


@query("a16_rollup", "SELECT n_regionkey AS domain, n_name AS subset, round(avg(c_acctbal), 6) AS accuracy, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)")
def a16(t):
    x = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumnsRenamed({"n_regionkey": "domain", "n_name": "subset"})
    return r6(M.rollup_accuracy(x, "domain", "subset", "c_acctbal"), "accuracy")


@query("a17_marginals", "SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'o_orderstatus' WHEN grouping(o_orderpriority) = 0 THEN 'o_orderpriority' ELSE 'overall' END AS dimension, coalesce(o_orderstatus, o_orderpriority) AS key, round(avg(o_totalprice), 4) AS accuracy, count(*)::BIGINT AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def a17(t):
    return M.breakdown(t.orders, ["o_orderstatus", "o_orderpriority"], "o_totalprice").withColumn("accuracy", F.round("accuracy", 4))


@query("a18_array_dimension", "WITH x AS (SELECT p_partkey, p_size, unnest(string_split(p_type, ' ')) AS skill FROM part) SELECT skill, round(100.0 * avg((p_size > 25)::INT), 2) AS accuracy, count(*)::BIGINT AS n FROM x GROUP BY skill")
def a18(t):
    x = t.part.select("p_size", F.explode(F.split("p_type", " ")).alias("skill"))
    return x.groupBy("skill").agg(F.round(100.0 * F.avg((F.col("p_size") > 25).cast("int")), 2).alias("accuracy"), F.count("*").alias("n"))


@query("a19_problem_version", "SELECT p_brand, CASE WHEN p_size > 25 THEN 'hard' ELSE 'easy' END AS version, round(avg(p_retailprice), 6) AS accuracy FROM part GROUP BY GROUPING SETS ((p_brand, 2), (p_brand), (2))")
def a19(t):
    x = t.part.select("p_brand", F.when(F.col("p_size") > 25, "hard").otherwise("easy").alias("version"), "p_retailprice")
    b, v = F.col("p_brand"), F.col("version")
    return r6(x.groupingSets([[b, v], [b], [v]], b, v).agg(F.avg("p_retailprice").alias("accuracy")), "accuracy")


@query("a20_average_and_worst_of_groups", f"WITH {EV} SELECT round(avg(m), 6) AS average, round(avg(w), 6) AS worst FROM (SELECT avg(s) AS m, min(s) AS w FROM ev GROUP BY uid)")
def a20(t):
    return r6(ev(t).groupBy("uid").agg(F.avg("s").alias("m"), F.min("s").alias("w")).agg(F.avg("m").alias("average"), F.avg("w").alias("worst")), "average", "worst")


@query("a21_four_quadrants", "WITH o AS (SELECT o_custkey, bool_or(o_totalprice > 2000) AS a, bool_or(o_orderstatus = 'F') AS b FROM orders GROUP BY 1) SELECT count(*) FILTER (WHERE a AND b)::BIGINT AS cm, count(*) FILTER (WHERE NOT a AND b)::BIGINT AS ik, count(*) FILTER (WHERE a AND NOT b)::BIGINT AS ig, count(*) FILTER (WHERE NOT a AND NOT b)::BIGINT AS rm FROM o")
def a21(t):
    o = t.orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_totalprice") > 2000).alias("a"), F.bool_or(F.col("o_orderstatus") == "F").alias("b"))
    a, b = F.col("a"), F.col("b")
    return o.agg(F.count_if(a & b).alias("cm"), F.count_if(~a & b).alias("ik"), F.count_if(a & ~b).alias("ig"), F.count_if(~a & ~b).alias("rm"))


@query("a22_first_n", f"WITH {EV}, h AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY id) AS k FROM ev), f AS (SELECT *, (s > 0)::INT AS acc FROM h WHERE k <= 8), v AS (SELECT uid, event_type, count(*) AS n, min(id) AS fst, arg_min(acc, id) AS value FROM f GROUP BY ALL), m AS (SELECT uid, value FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, fst) AS k FROM v) WHERE k = 1) SELECT uid, max(acc) AS cov, round(avg(acc), 6) AS avg, any_value(value) AS maj FROM f JOIN m USING (uid) GROUP BY uid")
def a22(t):
    return r6(M.first_n_scores(ev(t).withColumn("acc", (F.col("s") > 0).cast("int")), "uid", "id", "event_type", "acc", 8), "avg")


@query("a23_last_submission", f"WITH {EV} SELECT uid, event_type, arg_max(s, id) AS value FROM ev GROUP BY ALL")
def a23(t):
    return ev(t).groupBy("uid", "event_type").agg(F.max_by("s", "id").alias("value"))


@query("a24_mean_of_means", f"WITH {EV} SELECT round(avg(m), 6) AS acc, round(avg(f), 6) AS format FROM (SELECT avg(s) AS m, avg((len > 7)::INT) AS f FROM ev GROUP BY uid)")
def a24(t):
    return r6(ev(t).groupBy("uid").agg(F.avg("s").alias("m"), F.avg((F.col("len") > 7).cast("int")).alias("f")).agg(F.avg("m").alias("acc"), F.avg("f").alias("format")), "acc", "format")


@query("a25_size_weighted", f"WITH {EV}, g AS (SELECT avg(s) AS m, count(*) AS n FROM ev GROUP BY event_type) SELECT round(sum(m * n) / sum(n), 6) AS value FROM g")
def a25(t):
    return r6(M.weighted_mean(ev(t).groupBy("event_type").agg(F.avg("s").alias("m"), F.count("*").alias("n")), "m", "n"), "value")


@query("a26_worst_subtask", f"WITH {EV} SELECT round(min(m), 6) AS value FROM (SELECT avg(s) AS m FROM ev GROUP BY event_type)")
def a26(t):
    return r6(ev(t).groupBy("event_type").agg(F.avg("s").alias("m")).agg(F.min("m").alias("value")), "value")


@query("a27_token_usage", "SELECT conv_id, role, sum(length(text))::BIGINT AS tokens FROM conversations GROUP BY ROLLUP (conv_id, role)")
def a27(t):
    return t.conversations.rollup("conv_id", "role").agg(F.sum(F.length("text")).alias("tokens"))


@query("a28_run_summary", "SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE quality = 1)::BIGINT AS success, count(*) FILTER (WHERE quality = 0)::BIGINT AS failed, sum(n_chars)::BIGINT AS tokens FROM documents LEFT JOIN labels USING (doc_id)")
def a28(t):
    x = t.documents.join(t.labels, "doc_id", "left")
    return x.agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("success"), F.count_if(F.col("quality") == 0).alias("failed"), F.sum("n_chars").alias("tokens"))


@query("a29_funnel", "SELECT count(*)::BIGINT AS found, count(*) FILTER (WHERE quality IS NOT NULL)::BIGINT AS evaluated, count(*) FILTER (WHERE quality >= 1)::BIGINT AS passed, count(*) FILTER (WHERE quality >= 1 AND toxic = 0)::BIGINT AS clean FROM documents LEFT JOIN labels USING (doc_id)")
def a29(t):
    q, x = F.col("quality"), t.documents.join(t.labels, "doc_id", "left")
    return x.agg(F.count("*").alias("found"), F.count_if(q.isNotNull()).alias("evaluated"), F.count_if(q >= 1).alias("passed"), F.count_if((q >= 1) & (F.col("toxic") == 0)).alias("clean"))


@query("a30_distinct_average", "SELECT count(DISTINCT conv_id)::BIGINT AS n, round(count(*) / count(DISTINCT conv_id), 6) AS average FROM conversations")
def a30(t):
    return t.conversations.agg(F.count_distinct("conv_id").alias("n"), F.round(F.count("*") / F.count_distinct("conv_id"), 6).alias("average"))


@query("a31_cost", "SELECT role, round(sum(length(text)) / 1000.0 * 0.0025, 6) AS cost FROM conversations GROUP BY role")
def a31(t):
    return t.conversations.groupBy("role").agg(F.round(F.sum(F.length("text")) / 1000.0 * 0.0025, 6).alias("cost"))


@query("a32_tool_calls", "SELECT round(avg(n), 6) AS mean, min(n)::BIGINT AS min, max(n)::BIGINT AS max FROM (SELECT least(count(*), 5) AS n FROM conversations GROUP BY conv_id)")
def a32(t):
    n = t.conversations.groupBy("conv_id").agg(F.least(F.count("*"), F.lit(5)).alias("n"))
    return n.agg(F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 6).alias("mean"), F.coalesce(F.min("n"), F.lit(0)).alias("min"), F.coalesce(F.max("n"), F.lit(0)).alias("max"))


@query("a34_slowest", f"WITH {EV} SELECT round(min(s), 6) AS min, round(max(s), 6) AS max, round(avg(s), 6) AS mean, arg_max(id, s) AS slowest FROM ev WHERE id = (SELECT arg_max(id, s) FROM ev) OR true")
def a34(t):
    return r6(ev(t).agg(F.min("s").alias("min"), F.max("s").alias("max"), F.avg("s").alias("mean"), F.max_by("id", "s").alias("slowest")), "min", "max", "mean")


@query("a35_dpo_metrics", f"WITH {EV}, p AS (SELECT s, len, row_number() OVER (PARTITION BY uid ORDER BY s DESC, id) = 1 AS chosen FROM ev) SELECT round(avg(s) FILTER (WHERE chosen), 6) AS chosen, round(avg(s) FILTER (WHERE NOT chosen), 6) AS rejected, round(avg(len), 6) AS len FROM p")
def a35(t):
    p = ev(t).withColumn("chosen", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("s"), "id")) == 1)
    return r6(p.agg(F.avg(F.when(F.col("chosen"), F.col("s"))).alias("chosen"), F.avg(F.when(~F.col("chosen"), F.col("s"))).alias("rejected"), F.avg("len").alias("len")), "chosen", "rejected", "len")


@query("a36_sign_agreement", f"WITH {EV} SELECT round(avg((sign(s) = sign(len - 8))::INT), 6) AS value FROM ev")
def a36(t):
    return ev(t).agg(F.round(F.avg((F.signum("s") == F.signum(F.col("len") - 8)).cast("int")), 6).alias("value"))


@query("a38_imbalance", "SELECT min(s)::BIGINT AS min, max(s)::BIGINT AS max, (max(s) - min(s))::BIGINT AS gap, round(avg(s), 6) AS mean FROM (SELECT sum(n_chars) AS s FROM documents GROUP BY doc_id % 8)")
def a38(t):
    return r6(M.imbalance(t.documents.withColumn("b", F.col("doc_id") % 8), "b", "n_chars"), "mean")


@query("a39_append_to_dict", "SELECT event_type, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY event_type")
def a39(t):
    return t.events.groupBy("event_type").agg(F.array_join(F.sort_array(F.collect_list("event_id")).cast("array<string>"), ",").alias("ids"))


@query("a40_flops", "SELECT round((6.0 * 7000.0 * sum(n_chars) + 12.0 * 28 * 28 * 128 * sum(n_chars * n_chars)) / 1e9, 3) AS gflops FROM documents")
def a40(t):
    return t.documents.agg(F.round(M.dense_flops("n_chars", 7000.0, 28, 28, 128) / 1e9, 3).alias("gflops"))


@query("a41_first_k", f"WITH {EV} SELECT uid, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM (SELECT uid, id, row_number() OVER (PARTITION BY uid ORDER BY id) AS k FROM ev) WHERE k <= 8 GROUP BY uid")
def a41(t):
    k = ev(t).withColumn("k", F.row_number().over(Window.partitionBy("uid").orderBy("id"))).where("k <= 8")
    return k.groupBy("uid").agg(F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))


@query("j3_step_chain", "WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) SELECT a.o_custkey AS id, a.o_orderkey AS step1, b.o_orderkey AS step2, c.o_orderkey AS step3 FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.k = 2 LEFT JOIN o c ON a.o_custkey = c.o_custkey AND c.k = 3 WHERE a.k = 1")
def j3(t):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    steps = t.orders.select(F.col("o_custkey").alias("id"), "o_orderkey", k.alias("k")).where("k <= 3").groupBy("id").pivot("k", [1, 2, 3]).agg(F.first("o_orderkey"))
    return steps.toDF("id", "step1", "step2", "step3")


@query("j14_crossed_cells", "SELECT a.o_orderstatus, b.o_orderpriority, count(o.o_orderkey)::BIGINT AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM (SELECT DISTINCT o_orderstatus FROM orders) a CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) b LEFT JOIN orders o ON o.o_orderstatus = a.o_orderstatus AND o.o_orderpriority = b.o_orderpriority GROUP BY ALL")
def j14(t):
    return M.crossed(t.orders, ["o_orderstatus", "o_orderpriority"], "o_totalprice").withColumn("total", F.round("total", 2))


@query("t6_workload_order", "SELECT doc_id % 16 AS bucket, sum(n_chars * n_chars)::BIGINT AS load FROM documents GROUP BY 1 ORDER BY load DESC, min(doc_id) DESC")
def t6(t):
    g = t.documents.groupBy((F.col("doc_id") % 16).alias("bucket")).agg(F.sum(F.col("n_chars") * F.col("n_chars")).alias("load"), F.min("doc_id").alias("m"))
    return g.orderBy(F.desc("load"), F.desc("m")).select("bucket", "load")


@query("t8_breakdown_order", "SELECT lang, round(avg(n_chars), 2) AS accuracy FROM documents GROUP BY lang ORDER BY accuracy DESC")
def t8(t):
    return t.documents.groupBy("lang").agg(F.round(F.avg("n_chars"), 2).alias("accuracy")).orderBy(F.desc("accuracy"))
