"""Queries of group-relative and token-level operators (W, K, A12-A15, A33, A37, P21-P23, J11-J13, U9, T3-T5) on events and lineitem."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import batch as B
from tessera.operators import grouped as G
from tessera.operators import tokens as K
from tessera.plans.registry import query

EV = "ev AS (SELECT event_id AS id, user_id AS uid, value * 0.7310585786300049 AS s, length(props) AS len, event_type, ts FROM events)"
TOK = """tok AS (SELECT l_orderkey AS row_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS pos,
 -l_tax AS lp, -l_discount AS old, -l_quantity / 100 AS ref, l_quantity / 49 AS v, l_discount AS r, l_returnflag <> 'R' AS mask, (l_tax - 0.04) * 10 AS adv, l_linestatus = 'O' AS eos FROM lineitem)"""


def ev(t):
    return t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("uid"), (F.col("value") * 0.7310585786300049).alias("s"), F.length("props").cast("long").alias("len"), "event_type", "ts")


def tok(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return t.lineitem.select(
        F.col("l_orderkey").alias("row_id"), (F.row_number().over(w) - 1).cast("long").alias("pos"), (-F.col("l_tax")).alias("lp"), (-F.col("l_discount")).alias("old"), (-F.col("l_quantity") / 100).alias("ref"),
        (F.col("l_quantity") / 49).alias("v"), F.col("l_discount").alias("r"), (F.col("l_returnflag") != "R").alias("mask"), ((F.col("l_tax") - 0.04) * 10).alias("adv"), (F.col("l_linestatus") == "O").alias("eos"),
    )


def r6(df, *cols):
    """Columns rounded to 6 places; what rounds to zero from below is -0.0, as in the SQL."""
    for c in cols:
        signed = df.schema[c].dataType.typeName() == "double"
        df = df.withColumn(c, F.round(F.abs(c), 6) * F.signum(c) if signed else F.round(c, 6))
    return df


def adv(df):
    return r6(df.select("id", "advantage"), "advantage")


@query("w1_grpo", f"WITH {EV} SELECT id, round((s - CASE WHEN n = 1 THEN 0 ELSE m END) / (CASE WHEN n = 1 THEN 1 ELSE sd END + 1e-6), 6) AS advantage FROM (SELECT *, count(*) OVER g AS n, avg(s) OVER g AS m, stddev_samp(s) OVER g AS sd FROM ev WINDOW g AS (PARTITION BY uid))")
def w1(t):
    return adv(G.grpo(ev(t)))


@query("w1_dr_grpo", f"WITH {EV} SELECT id, round(s - CASE WHEN n = 1 THEN 0 ELSE m END, 6) AS advantage FROM (SELECT *, count(*) OVER g AS n, avg(s) OVER g AS m FROM ev WINDOW g AS (PARTITION BY uid))")
def w1d(t):
    return adv(G.grpo(ev(t), by_std=False))


@query("w2_passk", f"WITH {EV} SELECT id, round(CASE WHEN k = 1 THEN (s - nxt) / (sd + 1e-6) ELSE 0 END, 6) AS advantage FROM (SELECT *, row_number() OVER o AS k, lead(s) OVER o AS nxt, stddev_samp(s) OVER (PARTITION BY uid) AS sd FROM ev WINDOW o AS (PARTITION BY uid ORDER BY s DESC, id))")
def w2(t):
    return adv(G.passk(ev(t)))


@query("w3_reinforce_pp_baseline", f"WITH {EV}, c AS (SELECT id, s - CASE WHEN count(*) OVER g = 1 THEN 0 ELSE avg(s) OVER g END AS c FROM ev WINDOW g AS (PARTITION BY uid)) SELECT id, round((c - (SELECT avg(c) FROM c)) / sqrt((SELECT var_samp(c) FROM c) + 1e-8), 6) AS advantage FROM c")
def w3(t):
    return adv(G.reinforce_pp_baseline(ev(t)))


@query("w4_rloo", f"WITH {EV} SELECT id, round(CASE WHEN n > 1 THEN n / (n - 1) * (s - m) ELSE s END, 6) AS advantage FROM (SELECT *, count(*) OVER g AS n, avg(s) OVER g AS m FROM ev WINDOW g AS (PARTITION BY uid))")
def w4(t):
    return adv(G.rloo(ev(t)))


@query("w5_opo", f"WITH {EV} SELECT id, round(s - CASE WHEN n > 1 THEN b ELSE 0 END, 6) AS advantage FROM (SELECT *, count(*) OVER g AS n, sum(len * s) OVER g / sum(len) OVER g AS b FROM ev WINDOW g AS (PARTITION BY uid))")
def w5(t):
    return adv(G.opo(ev(t)))


@query("w6_gpg", f"WITH {EV}, al AS (SELECT count(*) / greatest(count(*) FILTER (WHERE s <> 0), 1) AS a FROM ev) SELECT id, round(a * (s - CASE WHEN n = 1 THEN 0 ELSE m END), 6) AS advantage FROM (SELECT *, count(*) OVER g AS n, avg(s) OVER g AS m FROM ev WINDOW g AS (PARTITION BY uid)), al")
def w6(t):
    return adv(G.gpg(ev(t)))


@query("w7_gae", f"""WITH RECURSIVE {TOK}, z AS (SELECT *, max(pos) OVER (PARTITION BY row_id) AS top FROM tok),
g AS (SELECT row_id, pos, CASE WHEN mask THEN v ELSE 0 END::DOUBLE AS nxt, CASE WHEN mask THEN r - v ELSE 0 END::DOUBLE AS last FROM z WHERE pos = top
UNION ALL SELECT z.row_id, z.pos, CASE WHEN z.mask THEN z.v ELSE g.nxt END, CASE WHEN z.mask THEN z.r + 0.99 * g.nxt - z.v + 0.99 * 0.95 * g.last ELSE g.last END FROM g JOIN z ON z.row_id = g.row_id AND z.pos = g.pos - 1)
SELECT row_id, pos::BIGINT AS pos, round(last, 6) AS advantage FROM g""")
def w7(t):
    rows = tok(t).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("pos", "r", "v", F.col("mask").cast("double").alias("m")))).alias("x"))
    out = rows.select("row_id", F.posexplode(K.gae(F.col("x.r"), F.col("x.v"), F.col("x.m"), 0.99, 0.95)).alias("pos", "advantage"))
    return r6(out.withColumn("pos", F.col("pos").cast("long")), "advantage")


@query("w8_reinforce_pp", f"""WITH RECURSIVE {TOK}, z AS (SELECT *, max(pos) OVER (PARTITION BY row_id) AS top FROM tok),
g AS (SELECT row_id, pos, r::DOUBLE AS ret, CASE WHEN mask THEN r ELSE 0 END::DOUBLE AS st FROM z WHERE pos = top
UNION ALL SELECT z.row_id, z.pos, z.r + 0.9 * g.st, CASE WHEN z.mask THEN z.r + 0.9 * g.st ELSE 0 END FROM g JOIN z ON z.row_id = g.row_id AND z.pos = g.pos - 1)
SELECT row_id, pos::BIGINT AS pos, round(ret, 6) AS ret FROM g""")
def w8(t):
    rows = tok(t).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("pos", "r", F.col("mask").cast("double").alias("m")))).alias("x"))
    out = rows.select("row_id", F.posexplode(K.discounted_returns(F.col("x.r"), F.col("x.m"), 0.9)).alias("pos", "ret"))
    return r6(out.withColumn("pos", F.col("pos").cast("long")), "ret")


@query("w9_remax", f"WITH {TOK} SELECT row_id, pos::BIGINT AS pos, round(sum(CASE WHEN mask THEN r ELSE 0 END) OVER (PARTITION BY row_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - CASE WHEN mask THEN avg(v) OVER (PARTITION BY row_id) ELSE 0 END, 6) + 0.0 AS advantage FROM tok")
def w9(t):
    x = tok(t)
    base = F.avg("v").over(Window.partitionBy("row_id"))
    m = F.col("mask")
    return x.select("row_id", "pos", (F.round(K.reverse_cumsum(F.when(m, F.col("r")).otherwise(0.0)) - F.when(m, base).otherwise(0.0), 6) + F.lit(0.0)).alias("advantage"))


@query("w10_consecutive_rloo", f"WITH {EV}, p AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 4 AS g FROM ev) SELECT id, round(s - (sum(s) OVER w - s) / greatest(count(*) OVER w - 1, 1), 6) AS advantage FROM p WINDOW w AS (PARTITION BY g)")
def w10(t):
    return adv(G.consecutive_rloo(B.with_pos(ev(t), "id"), "pos", 4, "s"))


@query("w11_sppo", f"WITH {EV}, m AS (SELECT max(s / 100) AS top FROM ev), b AS (SELECT top + ln(avg(exp(s / 100 - top))) AS sm FROM ev, m GROUP BY top) SELECT id, round(s / 100 - sm, 6) AS advantage FROM ev, b")
def w11(t):
    return adv(G.sppo(ev(t).withColumn("s", F.col("s") / 100)))


@query("w12_bon_weight", f"WITH {EV} SELECT id, round(n * pow(c, n - 1), 6) AS weight FROM (SELECT id, count(*) OVER (PARTITION BY uid) AS n, cume_dist() OVER (PARTITION BY uid ORDER BY s) AS c FROM ev)")
def w12(t):
    return r6(G.bon_weight(ev(t), "uid", "s").select("id", "weight"), "weight")


@query("w13_rollout_ordinal", f"WITH {EV}, i AS (SELECT *, row_number() OVER (ORDER BY id) - row_number() OVER (PARTITION BY event_type ORDER BY id) AS g FROM ev) SELECT id, (row_number() OVER (PARTITION BY event_type, g ORDER BY id) - 1)::BIGINT AS ordinal FROM i")
def w13(t):
    return G.rollout_ordinal(ev(t), "event_type", "id").select("id", F.col("ordinal").cast("long").alias("ordinal"))


@query("w14_response_mask", f"WITH {TOK} SELECT row_id, pos::BIGINT AS pos, (sum(eos::INT) OVER w - eos::INT = 0)::INT AS m FROM tok WINDOW w AS (PARTITION BY row_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def w14(t):
    return tok(t).select("row_id", "pos", K.response_mask(F.col("eos")).alias("m"))


@query("w15_position_ids", f"WITH {TOK} SELECT row_id, pos::BIGINT AS pos, ((sum(mask::INT) OVER (PARTITION BY row_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1) * mask::INT)::BIGINT AS position_id FROM tok")
def w15(t):
    return tok(t).select("row_id", "pos", K.position_ids(F.col("mask")).alias("position_id"))


@query("w16_adaptive_kl", """WITH RECURSIVE n AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS i, s_acctbal / 10000 AS x FROM supplier),
c AS (SELECT 0::BIGINT AS i, 0.2::DOUBLE AS coef UNION ALL SELECT n.i, coef * (1 + greatest(least(x / 0.1 - 1, 0.2), -0.2) * 32.0 / 1000.0) FROM c JOIN n ON n.i = c.i + 1) SELECT round(coef, 9) AS coef FROM c ORDER BY i DESC LIMIT 1""")
def w16(t):
    return t.supplier.agg(F.round(K.adaptive_kl(F.col("s_acctbal") / 10000, 32.0, 0.1, 1000.0, 0.2), 9).alias("coef"))


@query("p21_accuracy_band", f"WITH {EV}, g AS (SELECT uid, row_number() OVER (ORDER BY (avg((s > 0)::INT) BETWEEN 0.2 AND 0.8) DESC, uid) AS k, count(*) OVER () AS n FROM ev GROUP BY uid) SELECT id FROM ev JOIN g USING (uid) WHERE k <= n // 2")
def p21_share(t):
    e = ev(t).withColumn("a", (F.col("s") > 0).cast("int"))
    return G.band_filter(e, 0.2, 0.8, e.agg(F.countDistinct("uid")).first()[0] // 2, acc="a").select("id")  # 1 / oversample of the groups


@query("p22_informative_groups", f"WITH {EV} SELECT id FROM (SELECT id, stddev_pop(s) OVER g AS sd, count(*) OVER g AS n FROM ev WINDOW g AS (PARTITION BY uid, event_type)) WHERE sd > 0 OR n = 1")
def p22(t):
    return G.keep_informative(ev(t).withColumn("g", F.concat_ws("|", "uid", "event_type")), "g").select("id")


@query("p23_first_groups", f"WITH {EV} SELECT id FROM ev WHERE uid IN (SELECT DISTINCT uid FROM ev ORDER BY uid LIMIT 32)")
def p23(t):
    return G.first_groups(ev(t), 32).select("id")


@query("j11_group_broadcast", f"WITH {EV} SELECT id, count(*) OVER (PARTITION BY uid)::BIGINT AS n, round(avg(s) OVER (PARTITION BY uid), 6) AS peer FROM ev")
def j11(t):
    w = Window.partitionBy("uid")
    return ev(t).select("id", F.count("*").over(w).alias("n"), F.round(F.avg("s").over(w), 6).alias("peer"))


@query("j12_pairwise_agreement", f"WITH {EV} SELECT round(sum(abs(a.len - b.len) * (sign(a.s - b.s) = sign(a.len - b.len))::INT) / sum(abs(a.len - b.len)), 6) AS accuracy FROM ev a JOIN ev b ON a.uid = b.uid AND a.id < b.id")
def j12(t):
    return r6(G.pairwise_agreement(ev(t), "uid", "id", "s", "len"), "accuracy")


@query("j13_preference_pairs", f"WITH {EV}, p AS (SELECT id, s, (row_number() OVER (ORDER BY id) - 1) // 2 AS k FROM ev) SELECT id, row_number() OVER (PARTITION BY k ORDER BY s DESC, id) = 1 AS chosen FROM p")
def j13(t):
    return G.pair_preferences(B.with_pos(ev(t), "id").withColumn("k", F.floor(F.col("pos") / 2)), "k", "s", "id").select("id", "chosen")


@query("u9_resample_weights", f"WITH {EV} SELECT id, round(pow(abs(s), 2.0) + 1e-8, 4) AS weight FROM ev")
def u9(t):
    return G.resample_weights(ev(t)).select("id", F.round("weight", 4).alias("weight"))


@query("a12_masked_stats", f"WITH {TOK} SELECT round(sum(r) FILTER (WHERE mask), 4) AS total, round(sum(r) FILTER (WHERE mask) / (count(*) FILTER (WHERE mask) + 1e-8), 6) AS mean, round(var_samp(r) FILTER (WHERE mask), 6) AS var FROM tok")
def a12(t):
    m = F.col("mask")
    return tok(t).agg(F.round(K.masked_sum(F.col("r"), m), 4).alias("total"), F.round(K.masked_mean(F.col("r"), m), 6).alias("mean"), F.round(K.masked_var("r", "mask"), 6).alias("var"))


@query("a12_whiten", f"WITH {TOK}, m AS (SELECT avg(r) FILTER (WHERE mask) AS m, var_samp(r) FILTER (WHERE mask) AS var FROM tok) SELECT row_id, pos::BIGINT AS pos, round((r - m) / sqrt(var + 1e-8), 6) AS r FROM tok, m")
def a12w(t):
    return r6(K.whiten(tok(t), "r", "mask").select("row_id", "pos", "r"), "r")


_ROWS = "SELECT row_id, coalesce(sum(r) FILTER (WHERE mask), 0) AS s, count(*) FILTER (WHERE mask) AS n FROM tok GROUP BY row_id"


@query("a13_loss_modes", f"WITH {TOK}, rows AS ({_ROWS}) SELECT 'token-mean' AS mode, round(sum(r) FILTER (WHERE mask) / (count(*) FILTER (WHERE mask) + 1e-8), 6) AS loss FROM tok UNION ALL SELECT 'seq-mean-token-sum', round(avg(s), 6) FROM rows UNION ALL SELECT 'seq-mean-token-mean', round(avg(CASE WHEN n > 0 THEN s / n END), 6) FROM rows UNION ALL SELECT 'seq-mean-token-sum-norm', round(sum(s) / ((SELECT max(pos) FROM tok) + 1), 4) FROM rows")
def a13(t):
    x, out = tok(t), None
    for mode, digits in (("token-mean", 6), ("seq-mean-token-sum", 6), ("seq-mean-token-mean", 6), ("seq-mean-token-sum-norm", 4)):
        one = K.agg_loss(x, "r", "mask", mode).select(F.lit(mode).alias("mode"), F.round("loss", digits).alias("loss"))
        out = one if out is None else out.unionByName(one)
    return out


@query("a14_distributed_stats", "SELECT round(avg(s_acctbal), 6) AS mean, max(s_acctbal) AS max, min(s_acctbal) AS min, round(stddev_samp(s_acctbal), 6) AS std FROM supplier")
def a14(t):
    x = "s_acctbal"
    return t.supplier.agg(F.round(F.avg(x), 6).alias("mean"), F.max(x).alias("max"), F.min(x).alias("min"), F.round(F.stddev_samp(x), 6).alias("std"))


@query("a33_logprob_drift", f"WITH {TOK}, d AS (SELECT abs(exp(lp) - exp(old)) AS d FROM tok WHERE mask) SELECT round(max(d), 6) AS max, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS std FROM d")
def a33(t):
    d = tok(t).where("mask").select(F.abs(F.exp("lp") - F.exp("old")).alias("d"))
    return d.agg(F.round(F.max("d"), 6).alias("max"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.stddev_samp("d"), 6).alias("std"))


@query("a37_softmean", f"WITH {EV}, m AS (SELECT max(s / 50) AS top FROM ev) SELECT round((top + ln(avg(exp(s / 50 - top)))) / 2, 6) AS softmean FROM ev, m GROUP BY top")
def a37(t):
    return r6(G.softmean(ev(t).withColumn("s", F.col("s") / 100), "s", 2.0), "softmean")


@query("k1_kl_estimators", f"WITH {TOK} SELECT row_id, pos::BIGINT AS pos, round(lp - ref, 6) AS k1, round(abs(lp - ref), 6) AS abs, round(0.5 * (lp - ref) * (lp - ref), 6) AS k2, round(least(greatest(exp(greatest(least(ref - lp, 20), -20)) - greatest(least(ref - lp, 20), -20) - 1, -10), 10), 6) AS k3 FROM tok")
def k1(t):
    lp, ref = F.col("lp"), F.col("ref")
    return tok(t).select("row_id", "pos", *[F.round(K.kl(lp, ref, k), 6).alias(k) for k in ("k1", "abs", "k2", "k3")])


@query("k2_kl_reward", f"WITH {TOK} SELECT row_id, pos::BIGINT AS pos, round(r - 0.1 * (old - ref), 6) + 0.0 AS reward FROM tok")
def k2(t):
    return tok(t).select("row_id", "pos", (F.round(F.col("r") - 0.1 * (F.col("old") - F.col("ref")), 6) + F.lit(0.0)).alias("reward"))


@query("k3_kl_in_reward", f"WITH {TOK}, q AS (SELECT row_id, coalesce(sum(old - ref) FILTER (WHERE mask), 0) / (count(*) FILTER (WHERE mask) + 1e-8) AS k FROM tok GROUP BY row_id) SELECT round(avg(k), 6) AS kl, (SELECT round(sum(r - 0.05 * CASE WHEN mask THEN old - ref ELSE 0 END), 4) FROM tok) AS reward FROM q")
def k3(t):
    x, m = tok(t), F.col("mask")
    per = x.groupBy("row_id").agg(K.masked_mean(F.col("old") - F.col("ref"), m).alias("k")).agg(F.round(F.avg("k"), 6).alias("kl"))
    total = x.agg(F.round(F.sum(F.col("r") - 0.05 * F.when(m, F.col("old") - F.col("ref")).otherwise(0.0)), 4).alias("reward"))
    return per.crossJoin(F.broadcast(total))  # one row each


@query("k4_ppo_loss", f"WITH {TOK}, x AS (SELECT *, -adv * exp(lp - old) AS a, -adv * least(greatest(exp(lp - old), 0.98), 1.02) AS b FROM tok WHERE mask), y AS (SELECT *, greatest(a, b) AS w FROM x) SELECT round(avg(CASE WHEN adv < 0 THEN least(-adv * 3, w) ELSE w END), 6) AS loss, round(avg((b > a)::INT), 6) AS clipfrac, round(avg((w > -adv * 3 AND adv < 0)::INT), 6) AS clipfrac_lower FROM y")
def k4(t):
    loss, clip, low = K.ppo_loss(F.col("old"), F.col("lp"), F.col("adv"), 0.02, 0.02)
    return tok(t).where("mask").agg(F.round(F.avg(loss), 6).alias("loss"), F.round(F.avg(clip.cast("int")), 6).alias("clipfrac"), F.round(F.avg(low.cast("int")), 6).alias("clipfrac_lower"))


@query("k5_gpg_loss", f"WITH {TOK} SELECT round(avg(-lp * adv), 6) AS loss FROM tok WHERE mask")
def k5(t):
    return tok(t).where("mask").agg(F.round(F.avg(K.gpg_loss(F.col("old"), F.col("lp"), F.col("adv"))), 6).alias("loss"))


@query("k6_clip_cov_band", f"WITH {TOK}, m AS (SELECT avg(lp) AS l, avg(adv) AS a FROM tok WHERE mask) SELECT row_id, pos::BIGINT AS pos, round((lp - l) * (adv - a), 6) AS cov FROM tok, m WHERE mask AND round((lp - l) * (adv - a), 9) < -0.005")
def k6(t):
    return r6(K.covariance(tok(t), "lp", "adv", "mask").where("mask AND round(cov, 9) < -0.005").select("row_id", "pos", "cov"), "cov")


@query("k7_kl_cov_topk", f"WITH {TOK}, m AS (SELECT avg(lp) AS l, avg(adv) AS a FROM tok WHERE mask), c AS (SELECT row_id, pos, round((lp - l) * (adv - a), 9) AS cov FROM tok, m WHERE mask) SELECT row_id, pos::BIGINT AS pos FROM c ORDER BY cov DESC, row_id, pos LIMIT (SELECT greatest(1, floor(count(*) * 0.002))::BIGINT FROM c)")
def k7(t):
    c = K.covariance(tok(t), "lp", "adv", "mask").where("mask").withColumn("cov", F.round("cov", 9))
    return K.top_share(c, "cov", 0.002, "row_id", "pos").select("row_id", "pos")


@query("k8_value_loss", f"WITH {TOK} SELECT round(avg(0.5 * greatest((v - r) * (v - r), (greatest(least(v, old + 0.5), old - 0.5) - r) * (greatest(least(v, old + 0.5), old - 0.5) - r))), 6) AS loss FROM tok WHERE mask")
def k8(t):
    return tok(t).where("mask").agg(F.round(F.avg(K.value_loss(F.col("v"), F.col("r"), F.col("old"), 0.5)), 6).alias("loss"))


@query("k9_entropy", "WITH x AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), z AS (SELECT vec_id, e, list_max(e) AS m FROM x) SELECT vec_id, round(ln(list_sum(list_transform(e, lambda x: exp(x - m)))) + m - list_sum(list_transform(e, lambda x: exp(x - m) * x)) / list_sum(list_transform(e, lambda x: exp(x - m))), 6) AS entropy FROM z")
def k9(t):
    return t.embeddings.select("vec_id", F.round(K.entropy_of_logits(F.transform("embedding", lambda x: x.cast("double"))), 6).alias("entropy"))


@query("k10_dpo_loss", f"WITH {EV}, p AS (SELECT s / 100 AS m FROM ev) SELECT round(avg(0.9 * ln(1 + exp(-0.1 * m)) + 0.1 * ln(1 + exp(0.1 * m))), 6) AS sigmoid, round(avg((m - 5) * (m - 5)), 4) AS ipo FROM p")
def k10(t):
    m = F.col("s") / 100
    return ev(t).agg(F.round(F.avg(K.dpo_loss(m, 0.1, 0.1)), 6).alias("sigmoid"), F.round(F.avg(K.dpo_loss(m, 0.1, kind="ipo")), 4).alias("ipo"))


@query("k11_sequence_logps", f"WITH {TOK} SELECT row_id, round(coalesce(sum(lp) FILTER (WHERE mask), 0), 6) AS total, round(avg(lp) FILTER (WHERE mask), 6) AS mean FROM tok GROUP BY row_id")
def k11(t):
    m = F.col("mask")
    return r6(tok(t).groupBy("row_id").agg(K.masked_sum(F.col("lp"), m).alias("total"), F.avg(F.when(m, F.col("lp"))).alias("mean")), "total", "mean")


@query("k12_ce_dpo", f"WITH {EV}, p AS (SELECT 1 / (1 + exp(-0.01 * s)) AS q, (len % 2)::DOUBLE AS a FROM ev) SELECT round(avg(-(a * ln(q) + (1 - a) * ln(1 - q))), 6) AS loss FROM p")
def k12(t):
    q, a = 1 / (1 + F.exp(-0.01 * F.col("s"))), (F.col("len") % 2).cast("double")
    return ev(t).agg(F.round(F.avg(-(a * F.log(q) + (1 - a) * F.log(1 - q))), 6).alias("loss"))


@query("k13_sppo_loss", f"WITH {TOK} SELECT round(avg((lp - old - 0.5 * (r - 0.5)) * (lp - old - 0.5 * (r - 0.5))), 6) AS loss FROM tok WHERE mask")
def k13(t):
    d = F.col("lp") - F.col("old") - 0.5 * (F.col("r") - 0.5)
    return tok(t).where("mask").agg(F.round(F.avg(d * d), 6).alias("loss"))


@query("k14_overlong_penalty", "SELECT doc_id, round(least(-(n_chars - (2000 - 500)) / 500.0, 0), 6) AS penalty FROM documents")
def k14(t):
    return t.documents.select("doc_id", F.round(K.overlong_penalty(F.col("n_chars"), 2000, 500), 6).alias("penalty"))


@query("k15_last_token_reward", f"WITH {TOK} SELECT row_id, pos::BIGINT AS pos, CASE WHEN pos = max(pos) OVER (PARTITION BY row_id) THEN r ELSE 0 END AS reward FROM tok")
def k15(t):
    return tok(t).select("row_id", "pos", F.when(F.col("pos") == F.max("pos").over(Window.partitionBy("row_id")), F.col("r")).otherwise(0.0).alias("reward"))


@query("k16_clip_by_value", "SELECT s_suppkey, least(greatest(s_acctbal, 0), 5000) AS clipped FROM supplier")
def k16(t):
    return t.supplier.select("s_suppkey", F.least(F.greatest("s_acctbal", F.lit(0.0)), F.lit(5000.0)).alias("clipped"))


@query("t3_top2_per_group", f"WITH {EV} SELECT uid, id FROM (SELECT uid, id, row_number() OVER (PARTITION BY uid ORDER BY s DESC, id) AS k FROM ev) WHERE k <= 2")
def t3(t):
    return ev(t).withColumn("k", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("s"), "id"))).where("k <= 2").select("uid", "id")
