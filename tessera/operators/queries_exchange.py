"""Queries of dispatch, routing, balanced reordering, and of training rows of token arrays (X, J2, J15, T4, T5, F79-F84, E13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import batch as B
from tessera.operators import dispatch as D
from tessera.operators import preference as P
from tessera.operators import tokens as K
from tessera.operators.queries_rollout import TOK, tok
from tessera.plans.registry import query

LAYOUT = D.Layout(dp=2, tp=2, pp=2)
#: Customers by key at dense positions, with their parts of a cut into k after padding.
CUT = """c AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer), n AS (SELECT count(*) AS n FROM c),
f AS (SELECT id, p FROM c UNION ALL SELECT id, p + n FROM c, n WHERE p < ({k} - n % {k}) % {k}), h AS (SELECT id, p // ((SELECT count(*) FROM f) // {k}) AS part FROM f)"""


def customers(t):
    return B.with_pos(t.customer.select(F.col("c_custkey").alias("id")), "id")


def ranks_of(t, mode):
    return D.dispatch(customers(t), mode, LAYOUT).groupBy("rank").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.min("id").alias("low"), F.max("id").alias("high"))


_RANKS = "SELECT r::INT AS rank, count(*)::BIGINT AS n, sum(id)::BIGINT AS ids, min(id) AS low, max(id) AS high FROM h, range(8) t(r) WHERE {own} GROUP BY r"


@query("x10_dp_compute", f"WITH {CUT.format(k=8)} {_RANKS.format(own='part = r')}")
def x10_dp(t):
    return ranks_of(t, "dp_compute_proto")


@query("x10_megatron_compute", f"WITH {CUT.format(k=2)} {_RANKS.format(own='part = r // 2 % 2')}")
def x10_megatron(t):
    return ranks_of(t, "megatron_compute_proto")


@query("x10_pp_as_dp", f"WITH {CUT.format(k=4)} {_RANKS.format(own='part = r // 2 % 2 * 2 + r // 4')}")
def x10_pp_as_dp(t):
    return ranks_of(t, "megatron_pp_as_dp_proto")


@query("x10_one_to_all", f"WITH {CUT.format(k=1)} {_RANKS.format(own='true')}")
def x10_one_to_all(t):
    return ranks_of(t, "one_to_all")


@query("x10_rank_zero", f"WITH {CUT.format(k=1)} {_RANKS.format(own='r = 0')}")
def x10_rank_zero(t):
    return ranks_of(t, "rank_zero")


@query("x10_collected", f"WITH {CUT.format(k=2)} SELECT 'megatron_compute_proto' AS mode, count(*)::BIGINT AS n, sum(id)::BIGINT AS ids FROM h UNION ALL SELECT 'megatron_pp_only', 2 * count(*), 2 * sum(id) FROM c UNION ALL SELECT 'one_to_all', 8 * count(*), 8 * sum(id) FROM c UNION ALL SELECT 'rank_zero', count(*), sum(id) FROM c")
def x10_collected(t):
    out = None
    for mode in ("megatron_compute_proto", "megatron_pp_only", "one_to_all", "rank_zero"):
        one = D.collect(D.dispatch(customers(t), mode, LAYOUT), mode, LAYOUT).agg(F.lit(mode).alias("mode"), F.count("*").alias("n"), F.sum("id").alias("ids"))
        out = one if out is None else out.unionByName(one)
    return out


@query("e13_dispatch_registry", "SELECT * FROM (VALUES ('every_third', 3)) v(mode, ranks)")
def e13(t):
    if "every_third" not in D.DISPATCH_MODES.items:
        D.add_mode("every_third", D.Mode(lambda l: 0, lambda l, r: None, lambda l, r: r % 3 == 0))
    kept = D.collect(D.dispatch(customers(t), "every_third", LAYOUT), "every_third", LAYOUT)
    return kept.agg(F.lit("every_third").alias("mode"), F.countDistinct("rank").cast("int").alias("ranks"))


@query("x11_all_gather", "SELECT t::INT AS \"to\", string_agg(n_name, ',' ORDER BY n_nationkey % 4, n_nationkey) AS names FROM nation, range(4) r(t) GROUP BY t")
def x11(t):
    own = t.nation.select("n_nationkey", "n_name", (F.col("n_nationkey") % 4).alias("rank"))
    rows = F.array_sort(F.collect_list(F.struct("rank", "n_nationkey", "n_name")))
    return D.all_gather(own, 4).groupBy("to").agg(rows.alias("x")).select("to", F.array_join("x.n_name", ",").alias("names"))


@query("x12_routing", "WITH f AS (SELECT user_id, min(event_id) AS e FROM events GROUP BY user_id), r AS (SELECT user_id, (row_number() OVER (ORDER BY e, user_id) - 1) % 7 AS server FROM f) SELECT event_id, server::INT AS server FROM events JOIN r USING (user_id)")
def x12(t):
    return D.route(t.events.select("event_id", "user_id"), "user_id", "event_id", 7).select("event_id", "server")


#: Batches of eight events of a user, with sizes that differ, and their rank by size.
EIGHT = """e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
b AS (SELECT event_id, user_id || '/' || i // 8 AS batch, i % 8 AS j, (event_id * event_id * 26544357 + event_id * 12345) % 1000000007 + 1 AS size FROM e QUALIFY count(*) OVER (PARTITION BY user_id, i // 8) = 8),
k AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY size, j) - 1 AS r FROM b),
q AS (SELECT k.*, size + first_value(size) OVER (PARTITION BY batch, least(r, 7 - r) ORDER BY r DESC) + first_value(size) OVER (PARTITION BY batch, least(r, 7 - r) ORDER BY r) - size AS load FROM k)"""


def _residue(x):
    """(x * x * 26544357 + x * 12345) mod 1000000007, reduced at each step: of x beyond half a million the product passes 64 bits."""
    m = F.lit(1000000007).cast("long")
    r = F.pmod(x, m)  # the sum is never negative, so its remainder is that of the residues
    return (r * r % m * 26544357 % m + r * 12345) % m


def eights(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = t.events.select("event_id", "user_id", (F.row_number().over(w) - 1).alias("i"))
    b = e.select("event_id", F.concat_ws("/", "user_id", F.floor(F.col("i") / 8).cast("string")).alias("batch"), (_residue(F.col("event_id")) + 1).alias("size"))
    return b.withColumn("n", F.count("*").over(Window.partitionBy("batch"))).where("n = 8").drop("n")


def loads(df, part="part"):
    from pyspark.sql import Window

    return df.select("event_id", F.sum("size").over(Window.partitionBy("batch", part)).cast("long").alias("load"))


@query("x4_balanced_partitions", f"WITH {EIGHT} SELECT event_id, load::BIGINT AS load FROM q")
def x4(t):
    from tessera.operators import balance

    return loads(balance.balanced_partitions(eights(t), "batch", "event_id", "size", 4, True))


@query("x5_greedy_partitions", f"WITH {EIGHT}, a AS (SELECT batch, event_id, j, size, row_number() OVER (PARTITION BY batch ORDER BY size, j) AS turn FROM b WHERE j < 4), z AS (SELECT batch, event_id, size, j - 3 AS turn FROM b WHERE j >= 4) SELECT unnest([a.event_id, z.event_id]) AS event_id, unnest([a.size + z.size, a.size + z.size])::BIGINT AS load FROM a JOIN z USING (batch, turn)")
def x5(t):
    from tessera.operators import balance

    return loads(balance.balanced_partitions(eights(t), "batch", "event_id", "size", 4, True, balance.greedy))


_PLACES = f"WITH {EIGHT}, g AS (SELECT batch, load, dense_rank() OVER (PARTITION BY batch ORDER BY load DESC) - 1 AS rank, event_id, j FROM q) SELECT event_id, rank::BIGINT AS rank, (row_number() OVER (PARTITION BY batch ORDER BY rank, j) - 1)::BIGINT AS place FROM g"


@query("x6_partition_lists", f"SELECT event_id, rank FROM ({_PLACES})")
def x6(t):
    return D.balance_reorder(eights(t), "batch", "event_id", "size", 4).select("event_id", "rank")


@query("x9_balance_reorder", _PLACES)
def x9(t):
    return D.balance_reorder(eights(t), "batch", "event_id", "size", 4).select("event_id", "rank", "place")


@query("j2_union_meta", "SELECT 'orders' AS name, count(*)::BIGINT AS value FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'users', count(DISTINCT user_id) FROM events UNION ALL SELECT 'conflict', 1")
def j2(t):
    """Metadata of two batches, which share an entry, and what becomes of a third that contradicts them."""
    users = t.events.agg(F.countDistinct("user_id")).first()[0]
    meta = B.union_meta({"orders": t.orders.count(), "users": users}, {"events": t.events.count(), "users": users})
    try:
        B.union_meta(meta, {"users": users + 1})
        meta["conflict"] = 0
    except ValueError:
        meta["conflict"] = 1
    return t.spark.createDataFrame(list(meta.items()), "name string, value long")


@query("t4_top_share", "WITH k AS (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS k, count(*) OVER () AS n FROM events) SELECT event_id FROM k WHERE k <= greatest(1, floor(n * 0.05))")
def t4(t):
    return K.top_share(t.events.select("event_id", "value"), "value", 0.05, "event_id").select("event_id")


@query("t5_true_first", "SELECT event_id, (row_number() OVER (ORDER BY (value > 50) DESC, event_id) - 1)::BIGINT AS place FROM events")
def t5(t):
    e = t.events.select("event_id", (F.col("value") > 50).alias("ok"), (F.col("value") <= 50).cast("int").alias("late"))
    return B.with_pos(e, "late", "event_id", pos="place").select("event_id", "place")


_LINES = f"WITH {TOK}, a AS (SELECT row_id, list(CASE WHEN mask THEN 1 ELSE 0 END ORDER BY pos) AS m, list((pos * 7 + row_id) % 50 + 1 ORDER BY pos) AS ids, list(lp ORDER BY pos) AS lp, count(*) AS n FROM tok GROUP BY row_id)"


def lines(t):
    x = F.array_sort(F.collect_list(F.struct("pos", F.col("mask").cast("int").alias("m"), ((F.col("pos") * 7 + F.col("row_id")) % 50 + 1).cast("int").alias("id"), "lp")))
    a = tok(t).groupBy("row_id").agg(x.alias("x"))
    return a.select("row_id", F.col("x.m").alias("m"), F.col("x.id").alias("ids"), F.col("x.lp").alias("lp"))


def joined(x):
    return F.array_join(x.cast("array<string>"), ",")


@query("f79_loss_mask", _LINES + " SELECT row_id, array_to_string(list_transform(range(0, n), lambda i: CASE WHEN i < least(2, n) - 1 OR i = n - 1 THEN 0 ELSE 1 END), ',') AS mask FROM a")
def f79(t):
    return lines(t).select("row_id", joined(P.sft_loss_mask(F.transform("m", lambda _: F.lit(1)), F.lit(2))).alias("mask"))


@query("f80_turn_masks", """WITH m AS (SELECT conv_id, turn, role, length(text) % 4 + 1 AS n FROM conversations), k AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN '00' || repeat('1', n) ELSE repeat('0', n) END AS mask FROM m)
SELECT conv_id, string_agg(mask, '' ORDER BY turn) AS mask FROM k GROUP BY conv_id""")
def f80(t):
    tokens = F.array_repeat(F.lit(7), (F.length("text") % 4 + 1).cast("int"))
    m = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.array(F.lit(1), F.lit(2)).alias("prompt"), tokens.alias("tokens")))).alias("messages"))
    return m.select("conv_id", F.array_join(F.flatten(F.transform(P.turn_masks(F.col("messages")), lambda r: r["mask"])).cast("array<string>"), "").alias("mask"))


@query("f81_reward_pairs", _LINES + " SELECT row_id, array_to_string(list_resize(list_concat(ids, [n], [99])[1:6], 6, 0), ',') AS chosen, array_to_string(list_resize(list_concat(ids, [99])[1:6], 6, 0), ',') AS rejected, least(n + 2, 6)::BIGINT AS chosen_length, least(n + 1, 6)::BIGINT AS rejected_length FROM a")
def f81(t):
    rows = lines(t).select("row_id", F.col("ids").alias("prompt"), F.array(F.size("ids")).alias("yes"), F.array().cast("array<int>").alias("no"))
    out = P.reward_pairs(rows, "prompt", "yes", "no", 6, 99)
    total = lambda i: F.aggregate(F.col("attention_mask")[i], F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("row_id", joined(F.col("input_ids")[0]).alias("chosen"), joined(F.col("input_ids")[1]).alias("rejected"), total(0).alias("chosen_length"), total(1).alias("rejected_length"))


@query("f84_nested_lists", _LINES + " SELECT row_id, array_to_string(ids, ',') AS ids, n::BIGINT AS n FROM a")
def f84(t):
    rows = lines(t).select("row_id", F.struct(F.array(F.struct(F.col("ids").alias("v"))).alias("inner")).alias("x"))
    x = P.as_lists(rows.schema["x"].dataType, F.col("x"))
    return rows.select("row_id", x.alias("x")).select("row_id", joined(F.col("x.inner")[0]["v"]).alias("ids"), F.size(F.col("x.inner")[0]["v"]).cast("long").alias("n"))


@query("j15_preference_batch", _LINES + """, y AS (SELECT *, row_number() OVER (PARTITION BY row_id % 2 ORDER BY row_id) - 1 AS pair, list_transform(ids, lambda x, i: CASE WHEN i <= 2 THEN -100 ELSE x END) AS labels,
list_sum(list_transform(list_zip(lp, m), lambda z: z[1] * z[2])) AS logp FROM a)
SELECT c.pair::BIGINT AS pair, c.row_id AS chosen, r.row_id AS rejected, array_to_string(c.labels, ',') AS chosen_labels, array_to_string(r.labels, ',') AS rejected_labels, round(c.logp, 6) AS chosen_logp, round(r.logp, 6) AS rejected_logp FROM y c JOIN y r USING (pair) WHERE c.row_id % 2 = 1 AND r.row_id % 2 = 0""")
def j15(t):
    rows = lines(t).withColumn("good", F.col("row_id") % 2 == 1)
    p = P.preference_batch(rows, "good", "row_id", "ids", 2, "lp", "m")
    return p.select("pair", F.col("chosen_row_id").alias("chosen"), F.col("rejected_row_id").alias("rejected"), joined(F.col("chosen_labels")).alias("chosen_labels"), joined(F.col("rejected_labels")).alias("rejected_labels"), F.round("chosen_logp", 6).alias("chosen_logp"), F.round("rejected_logp", 6).alias("rejected_logp"))
