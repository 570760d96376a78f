"""Queries of scorer dispatch, registries and declarative evaluation (E, S-dispatch, L cores)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans import scoring as P
from tessera.plans.registry import query

@query("e1_scorer_dispatch", """SELECT doc_id, CASE WHEN doc_id % 32 = 4 THEN CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE 1.0 END
WHEN doc_id % 7 IN (2, 3) THEN CASE WHEN doc_id % 3 = 0 THEN -1.0 ELSE 1.0 END WHEN doc_id % 7 = 5 THEN CASE WHEN doc_id % 3 = 0 THEN 0.1 ELSE 1.0 END WHEN doc_id % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS score FROM documents""")
def e1(t):
    """Every family of sources over replies that hold a whole text and then state its length n, rightly or as n + 1, in another notation than the truth."""
    k, n = F.col("doc_id") % 7, F.length("text")
    said = (n + (F.col("doc_id") % 3 == 0).cast("int")).cast("string")
    n, text, join = n.cast("string"), F.col("text"), lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    rows = [
        ("openai/gsm8k", join(text, "\n#### ", F.regexp_replace(said, r"(\d)(?=(\d{3})+$)", "$1,")), n),
        ("HuggingFaceH4/MATH-500", join(text, " \\boxed{1/", said, "}"), join("\\frac{1}{", n, "}")),
        ("math_dapo", join(text, "\nAnswer: x = ", said, " dollars"), join("$", n, "$")),
        ("aime2024", join(text, "\nanswer : \\text{", said, "}"), n),
        ("numina_olympiads", join(text, ". The answer is ", said, "+x. So it is"), join("x+", n)),
        ("hiyouga/geometry3k", join("<think>", text, "</think> \\boxed{\\frac{y+", said, "}{2}}"), join("\\frac{", n, "+y}{2}")),
        ("searchR1_nq", join("<answer>", text, "</answer> <answer> The L", said, ".</answer>"), join("another\x1fl", n)),
    ]
    program = join("first ```python\nx=1``` then ```python\nprint(int(input()) + ", n, ")\n``` ", F.regexp_replace(text, "`", "'"))
    tests = join('{"inputs": ["0", "1"], "outputs": ["', n, '\\n", "', (F.length("text") + 1 + (F.col("doc_id") % 3 == 0).cast("int")).cast("string"), '"]}')
    pick = lambda i: F.when(F.col("doc_id") % 32 == 4, [F.lit("codecontests"), program, tests][i]).otherwise(F.get(F.array(*[F.lit(r[i]) if i == 0 else r[i] for r in rows]), k.cast("int")))
    return P.score(t.documents.select("doc_id", pick(0).alias("data_source"), pick(1).alias("response"), pick(2).alias("ground_truth"))).select("doc_id", "score")


_PACKED = """WITH d AS (SELECT doc_id, source, lang, length(coalesce(text, '')) AS n FROM documents WHERE text IS NOT NULL), r AS (SELECT *, (n % 3 <> 0)::INT::DOUBLE AS ok, CASE WHEN n < 400 THEN 'short' WHEN n < 1500 THEN 'medium' ELSE 'long' END AS duration FROM d),
e AS (SELECT 'videomme' AS pack, 'acc' AS metric, unnest(['duration', 'category', 'duration_category', 'overall']) AS dimension, unnest([duration, source, duration || '_' || source, NULL]) AS key, ok AS value FROM r
UNION ALL SELECT 'mmmu', 'acc', unnest(['subject', 'domain', 'overall']), unnest([source, CASE WHEN lang IN ('en', 'de') THEN 'north' ELSE 'south' END, NULL]), ok FROM r WHERE lang IS NOT NULL
UNION ALL SELECT 'mathvista', 'acc', unnest(['answer_type', 'skill', 'skill', 'overall']), unnest([CASE WHEN n % 2 = 0 THEN 'integer' ELSE 'float' END, lang, duration, NULL]), ok FROM r
UNION ALL SELECT 'mathvista', 'read', 'overall', NULL, 1.0 FROM r),
u AS (SELECT doc_id // 3 AS unit, coalesce(bool_and(ok = 1) FILTER (WHERE doc_id % 3 = 0), FALSE) AS a, coalesce(bool_and(ok = 1) FILTER (WHERE doc_id % 3 = 1), FALSE) AS b, coalesce(bool_and(ok = 1) FILTER (WHERE doc_id % 3 = 2), FALSE) AS m FROM r GROUP BY 1),
w AS (SELECT 'wemath' AS pack, unnest(['inadequate_generalization', 'insufficient_knowledge', 'complete_mastery_strict', 'rote_memorization_strict', 'score_strict', 'complete_mastery_loose', 'rote_memorization_loose', 'score_loose']) AS metric, 'overall' AS dimension, NULL AS key,
unnest([(a AND b AND NOT m)::INT::DOUBLE, (NOT (a AND b) AND NOT m)::INT::DOUBLE, (a AND b AND m)::INT::DOUBLE, CASE WHEN m THEN (NOT (a AND b))::INT::DOUBLE END, CASE WHEN m THEN (a AND b)::INT::DOUBLE WHEN a AND b THEN 0.5 ELSE 0.0 END, ((a OR b) AND m)::INT::DOUBLE, CASE WHEN m THEN (NOT (a OR b))::INT::DOUBLE END, CASE WHEN m THEN (a OR b)::INT::DOUBLE WHEN a AND b THEN 0.5 ELSE 0.0 END]) AS value FROM u)
SELECT pack, metric, dimension, key, round(avg(value), 6) AS value, count(*)::BIGINT AS n FROM (SELECT * FROM e UNION ALL SELECT * FROM w) WHERE value IS NOT NULL GROUP BY ALL"""


def packs():
    """Four packs that differ in kind, over replies that hold a whole text: a letter by video length and category, a bracketed choice by subject and domain, a number by kind and skills, and problems in steps."""
    from tessera.functions import choices as H
    from tessera.functions import latex as L
    from tessera.functions import text as X
    from tessera.plans.packs import Dimension, Measure, Pack, mastery

    n, source, lang, col = F.col("n"), F.col("source"), F.col("lang"), F.col
    letters = F.array(*map(F.lit, "ABCD"))
    gold = F.substring(F.lit("ABCD"), n % 4 + 1, F.lit(1))
    right = lambda truth: lambda answer: F.coalesce(answer == truth, F.lit(False))
    by = lambda *dims: lambda s: [Measure("acc", s, dims)]
    duration = Dimension("duration", col("duration"))
    return [
        Pack("videomme", right(gold), [H.first_letter(col("letter_reply"))], by(duration, Dimension("category", source), Dimension("duration_category", F.concat("duration", F.lit("_"), "source"))), prompt=F.concat(F.lit("Watch and choose: "), "text")),
        Pack("mmmu", right(gold), [H.parse_brackets(col("bracket_reply"), letters, F.array(*map(F.lit, ("no 1", "no 2", "no 3", "no 4"))))], by(Dimension("subject", source), Dimension("domain", F.when(lang.isin("en", "de"), "north").otherwise("south"))), rows=lang.isNotNull(), prompt=F.concat(F.lit("Choose a letter: "), "text")),
        Pack("mathvista", lambda a: L.close(L.number_of(a), n.cast("double")), [X.last_boxed_balanced(col("number_reply")), X.last(X.numbers(col("number_reply")))], lambda s: [*by(Dimension("answer_type", F.when(n % 2 == 0, "integer").otherwise("float")), Dimension("skill", F.array("lang", "duration"), many=True))(s), Measure("read", s.isNotNull())]),
        Pack("wemath", right(gold), [H.first_letter(col("letter_reply"))], mastery(["0", "1"], "2"), unit=F.floor(col("doc_id") / 3), step=col("doc_id") % 3),
    ]


@query("e14_packs", _PACKED)
def e14_packs(t):
    from tessera.plans.packs import evaluate

    n = F.length("text")
    said = F.substring(F.lit("ABCD"), (n + (n % 3 == 0).cast("int")) % 4 + 1, F.lit(1))
    value = (n + F.when(n % 3 == 0, n).otherwise(0)).cast("string")
    d = t.documents.where("text is not null").select(
        "doc_id", "source", "lang", "text", n.alias("n"), F.when(n < 400, "short").when(n < 1500, "medium").otherwise("long").alias("duration"),
        F.concat(F.lit("The best answer is ("), said, F.lit(") as in "), "text").alias("letter_reply"), F.concat("text", F.lit(" so I take ("), said, F.lit(")")).alias("bracket_reply"),
        F.concat("text", F.when(n % 2 == 0, F.concat(F.lit(" \\boxed{"), value, F.lit("}"))).otherwise(F.concat(F.lit(" it comes to "), value, F.lit(".0")))).alias("number_reply"),
    )
    return evaluate(d, packs()).withColumn("value", F.round("value", 6))


@query("e14_prompts", "SELECT doc_id, unnest(['videomme', 'mmmu'][1 : CASE WHEN lang IS NULL THEN 1 ELSE 2 END]) AS pack, unnest(['Watch and choose: ' || text, 'Choose a letter: ' || text][1 : CASE WHEN lang IS NULL THEN 1 ELSE 2 END]) AS prompt FROM documents WHERE text IS NOT NULL")
def e14_prompts(t):
    from tessera.plans.packs import prompts

    d = t.documents.where("text is not null").withColumns({"n": F.length("text"), "duration": F.lit(""), "letter_reply": F.lit(""), "bracket_reply": F.lit(""), "number_reply": F.lit("")})
    return prompts(d, packs()).select("doc_id", "pack", "prompt")


@query("e3_batch_scorer", "SELECT doc_id, (doc_id % 2)::DOUBLE AS score FROM documents")
def e3(t):
    return P.score_batch(t.documents.select("doc_id"), lambda i: i % 2, ["doc_id"]).select("doc_id", "score")


@query("e8_failing_scorer", "SELECT doc_id, 0.0::DOUBLE AS score FROM documents")
def e8(t):
    return P.score_batch(t.documents.select("doc_id"), lambda i: 1 / 0, ["doc_id"]).select("doc_id", "score")


@query("e14_eval_task", "SELECT lang, round(avg((doc_id % 2)::DOUBLE), 6) AS acc FROM documents GROUP BY lang")
def e14(t):
    task = P.EvalTask("boxed", lambda: F.concat(F.lit("Q: "), "text"), "boxed")
    d = t.documents.withColumn("reply", F.concat(F.lit("\\boxed{"), (F.col("doc_id") % 2).cast("string"), F.lit("}"))).withColumn("truth", F.lit("1"))
    return task.evaluate(d, "reply", "truth", ["lang"]).withColumn("acc", F.round("acc", 6))


@query("e17_generator_table", "SELECT c_custkey, unnest(range(0, c_nationkey % 4 + 1))::BIGINT AS k FROM customer")
def e17(t):
    return t.customer.select("c_custkey", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("c_nationkey") % 4).cast("long"))).alias("k"))


@query("l6_text_summary", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, string_agg('Video_event ' || i || ' [' || event_id || '.0s – ' || event_id || '.5s]: ' || event_type, chr(10) ORDER BY event_id) AS summary, any_value(n)::BIGINT AS segments, any_value(ceil(n / CASE WHEN n < 8 THEN n WHEN n <= 16 THEN 4 ELSE 8 END))::BIGINT AS groups FROM n GROUP BY user_id""")
def l6(t):
    """Every user's events as captions of half a second; the model here repeats the event lines that it is shown, the last first."""
    from tessera.operators.video import summarize

    shown = lambda prompt: "\n".join(reversed([x for x in prompt.splitlines() if x.startswith("Video_event")])) + "\nThat is all."
    e = t.events.select("user_id", "event_id", (F.col("event_id") + 0.5).alias("end"), "event_type")
    return summarize(e, "user_id", "event_id", "end", "event_type", shown)


@query("l10_generation_rows", "SELECT doc_id, length(text)::BIGINT AS first, length(text)::BIGINT + 1 AS second, md5(text || '#1') AS last FROM documents WHERE text IS NOT NULL")
def l10(t):
    """Two passes over batches of 100 whole texts; the model here appends the number of the pass."""
    from tessera.plans.agents import generate_batches

    class Model:
        def __init__(self):
            self.calls = 0

        def __call__(self, prompts):
            if len(prompts) != 100:
                raise ValueError("a batch is full")
            self.calls += 1
            return [p if self.calls % 2 else p + "#1" for p in prompts]  # twice "#1" has two more characters

    made = generate_batches(t.documents.where("text is not null").select("doc_id", "text"), Model(), "doc_id", "text", 2, 100)
    r = F.col("responses")
    return made.select("doc_id", F.length(r[0]).cast("long").alias("first"), (F.length(r[1]) - 1).cast("long").alias("second"), F.md5(r[1].cast("binary")).alias("last"))
