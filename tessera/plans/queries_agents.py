"""Queries of scorer loading, managers, registries, agents, tools and interactions (E2-E16, R9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import grouped as G
from tessera.operators import tokens as K
from tessera.operators.queries_rollout import TOK, adv, ev, tok
from tessera.plans import agents as A
from tessera.plans import scoring as P
from tessera.plans.registry import Registry, query
from tessera.sources import files


@query("e2_loaded_scorer", "SELECT doc_id, (length(lang) * 3 + 1)::DOUBLE AS score FROM documents WHERE lang IS NOT NULL")
def e2(t):
    path = f"{files.shared_folder(t.spark)}/scorer.py"
    files.write_text(t.spark, path, "def score(text, weight=1, bias=0):\n    return len(text) * weight + bias\n")
    f = A.load_function(t.spark, path, "score", weight=3, bias=1)
    return P.score_batch(t.documents.where("lang is not null").select("doc_id", "lang"), f, ["lang"]).select("doc_id", "score")


@query("e4_reward_managers", "SELECT name, doc_id, CASE name WHEN 'dapo' THEN least(-(n_chars - 300) / 100.0, 0) + s ELSE s END::DOUBLE AS score FROM (SELECT doc_id, n_chars, (doc_id % 2)::DOUBLE AS s FROM documents), (VALUES ('naive'), ('batch'), ('prime'), ('dapo')) v(name)")
def e4(t):
    d = t.documents.select("doc_id", F.lit("lighteval/MATH").alias("data_source"), F.concat(F.lit("\\boxed{"), (F.col("doc_id") % 2).cast("string"), F.lit("}")).alias("response"), F.lit("1").alias("ground_truth"), F.col("n_chars").alias("length"))
    out = None
    for name, more in (("naive", {}), ("batch", {"f": lambda s, r, g: float(r == "\\boxed{%s}" % g)}), ("prime", {"f": lambda s, r, g: float(r == "\\boxed{%s}" % g)}), ("dapo", {"maximum": 400, "buffer": 100})):
        one = P.REWARD_MANAGERS.get(name)(d, **more).select(F.lit(name).alias("name"), "doc_id", "score")
        out = one if out is None else out.unionByName(one)
    return out


def registry_rows(t, registry: Registry, taken: str):
    """Known names, and what becomes of a taken and of an unknown one."""
    rows = [(n, "known") for n in sorted(registry.items)]
    for name, use in ((taken, lambda: registry.register(taken)(object())), (taken.upper(), lambda: registry.get(taken.upper()))):
        try:
            use()
            rows.append((name, "taken"))
        except (ValueError, KeyError) as e:
            rows.append((name, type(e).__name__))
    return t.spark.createDataFrame(rows, "name string, state string")


@query("e5_advantage_registry", "SELECT * FROM (VALUES ('gpg', 'known'), ('grpo', 'known'), ('grpo_passk', 'known'), ('opo', 'known'), ('reinforce_plus_plus_baseline', 'known'), ('rloo', 'known'), ('grpo', 'ValueError'), ('GRPO', 'KeyError')) v(name, state)")
def e5(t):
    return registry_rows(t, G.ADVANTAGES, "grpo")


@query("e5_advantage_by_name", "SELECT event_id AS id, round(CASE WHEN n > 1 THEN n / (n - 1) * (s - m) ELSE s END, 6) AS advantage FROM (SELECT event_id, value * 0.7310585786300049 AS s, count(*) OVER g AS n, avg(value * 0.7310585786300049) OVER g AS m FROM events WINDOW g AS (PARTITION BY user_id))")
def e5_by_name(t):
    return adv(G.ADVANTAGES.get("rloo")(ev(t)))


@query("e6_loss_registry", f"""WITH {TOK}, x AS (SELECT -v AS old, -v - r / 4 AS lp, r - 0.05 AS adv FROM tok WHERE mask), y AS (SELECT *, exp(greatest(least(lp - old, 20), -20)) AS ratio FROM x),
z AS (SELECT *, greatest(-adv * ratio, -adv * greatest(least(ratio, 1.2), 0.8)) AS worse FROM y)
SELECT 'gpg' AS name, round(avg(-lp * adv), 6) AS loss FROM z UNION ALL SELECT 'vanilla', round(avg(CASE WHEN adv < 0 THEN least(-adv * 3.0, worse) ELSE worse END), 6) FROM z UNION ALL SELECT 'unknown', NULL""")
def e6(t):
    """The mean loss of the tokens by every registered name; of a name that is not registered none."""
    x = tok(t).where("mask").select((-F.col("v")).alias("old"), (-F.col("v") - F.col("r") / 4).alias("lp"), (F.col("r") - 0.05).alias("adv"))
    columns = []
    for name in [*sorted(K.POLICY_LOSSES.items), "unknown"]:
        try:
            loss = K.POLICY_LOSSES.get(name)(F.col("old"), F.col("lp"), F.col("adv"))
            loss = F.round(F.avg(loss[0] if isinstance(loss, tuple) else loss), 6)
        except KeyError:
            loss = F.lit(None).cast("double")
        columns.append(F.struct(F.lit(name).alias("name"), loss.alias("loss")))
    return x.agg(F.array(*columns).alias("x")).select(F.inline("x"))


@query("e7_custom_reader", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 1 ORDER BY c_custkey")
def e7(t):
    if "odd_customers" not in P.READERS.items:
        P.READERS.register("odd_customers")(lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 2 = 1").select("c_custkey", "c_name"))
    return P.READERS.get("odd_customers")(t.spark, t.sf_dir)


@query("e9_timeout", "SELECT r_regionkey, (r_regionkey <> 1)::INT::DOUBLE AS score FROM region")
def e9(t):
    def slow(key):
        import time

        time.sleep(3 if key == 1 else 0)
        return 1.0

    return P.score_batch(t.region.coalesce(1), slow, ["r_regionkey"], seconds=0.5).select("r_regionkey", "score")


def _calls(messages):
    """Calls the answer tool as often as the prompt's number says, with better and better answers, then stops."""
    want, done = int(messages[0]["content"].split()[-1]), sum(m["role"] == "tool" for m in messages)
    return "thinking <tool_call>{\"name\":\"answer\",\"arguments\":{\"answer\":%d}}</tool_call>" % done if done < want else "done"


def conversations(t):
    return t.customer.select("c_custkey", F.concat(F.lit("calls "), (F.col("c_custkey") % 3).cast("string")).alias("prompt"), F.lit("0").alias("truth"))


@query("r9_agent_loop", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '11001' ELSE '110011' END AS mask, CASE c_custkey % 3 WHEN 0 THEN 2 ELSE 4 END AS turns, CASE c_custkey % 3 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM customer")
def r9(t):
    out = A.run_loop(conversations(t), lambda: A.AGENT_LOOPS.get("tool_agent")(_calls, [A.AnswerTool()], response=6), "c_custkey", "prompt", "truth")
    return out.select("c_custkey", F.array_join(F.col("mask").cast("array<string>"), "").alias("mask"), "turns", "reward")


@query("e10_tool_states", "SELECT c_custkey, (c_custkey % 3 = 1)::INT::DOUBLE AS reward, 2 + 2 * (c_custkey % 3)::INT AS turns FROM customer")
def e10(t):
    out = A.run_loop(conversations(t), lambda: A.AGENT_LOOPS.get("tool_agent")(_calls, [A.AnswerTool()]), "c_custkey", "prompt", "truth")
    return out.select("c_custkey", "reward", "turns")


@query("e11_interaction", "SELECT c_custkey, least(c_custkey % 5 + 1, 3)::INT AS turns, (c_custkey % 5 < 3)::INT::DOUBLE AS reward FROM customer")
def e11(t):
    c = t.customer.select("c_custkey", F.lit("count").alias("prompt"), (F.col("c_custkey") % 5).cast("string").alias("truth"))
    count = lambda messages: str(sum(m["role"] == "assistant" for m in messages))
    return A.interact(c, lambda: A.Interaction(lambda said, truth: said == truth), count, "c_custkey", "prompt", "truth", 3)


@query("e12_loop_registry", """SELECT c_custkey, 2 AS single_turn, 2 + 2 * (c_custkey % 3)::INT AS tool_agent, 'KeyError' AS other FROM customer""")
def e12(t):
    """The turns of every customer's conversation under each registered loop."""
    out, other = conversations(t).select("c_custkey"), "none"
    for name in sorted(A.AGENT_LOOPS.items):
        made = A.run_loop(conversations(t), lambda name=name: A.AGENT_LOOPS.get(name)(_calls, tools=[A.AnswerTool()]), "c_custkey", "prompt", "truth")
        out = out.join(made.select("c_custkey", F.col("turns").alias(name)), "c_custkey")
    try:
        A.AGENT_LOOPS.get("other")
    except KeyError as e:
        other = type(e).__name__
    return out.withColumn("other", F.lit(other))


@query("e15_client_call", "SELECT n_nationkey, 'said: ' || n_name AS reply FROM nation")
def e15(t):
    from tessera.operators.curation import pipeline_call

    return pipeline_call(t.nation, A.CLIENTS.get("echo")("said: "), "n_name", "reply").select("n_nationkey", "reply")


@query("e16_python_aggregates", "SELECT user_id, round(max(value) - min(value), 6) AS span, round(median(value), 6) AS middle FROM events GROUP BY user_id")
def e16(t):
    out = A.reduce_groups(t.events.select("user_id", "value"), "user_id", "value", {"span": lambda s: s.max() - s.min(), "middle": lambda s: s.median()})
    return out.select("user_id", F.round("span", 6).alias("span"), F.round("middle", 6).alias("middle"))
