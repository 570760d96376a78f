import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import balance, curation
from tessera.operators import batch as B
from tessera.operators import grouped as G
from tessera.operators import metrics as M
from tessera.operators import tokens as K
from tessera.plans import scoring
from tessera.plans.registry import Registry
from tessera.sources import io
from tessera.streaming import stateful


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def abc(spark, n=3):
    return frame(spark, [(i, "abcdef"[i]) for i in range(n)], "pos long, x string")


def col(df, order, name):
    return [r[name] for r in df.orderBy(order).collect()]


def test_reorder_and_take(spark):
    df = frame(spark, [(i, i + 1, "abcdef"[i]) for i in range(6)], "pos long, obs long, x string")
    out = B.take(df, [3, 4, 2, 0, 1, 5])
    assert col(out, "pos", "obs") == [4, 5, 3, 1, 2, 6]
    assert col(out, "pos", "x") == list("decabf")
    assert col(B.take(df, slice(1, 5, 2)), "pos", "x") == ["b", "d"]
    assert col(B.take(df, F.col("obs") > 4), "pos", "x") == ["e", "f"]


def test_chunk_needs_equal_parts():
    with pytest.raises(ValueError):
        B.chunk_of(F.lit(0), 6, 5)


def test_repeat(spark):
    assert col(B.repeat(abc(spark), 2), "pos", "x") == list("aabbcc")
    assert col(B.repeat(abc(spark), 2, interleave=False), "pos", "x") == list("abcabc")


@pytest.mark.parametrize("divisor,pad", [(2, 1), (3, 0), (8, 5)])
def test_pad_and_unpad(spark, divisor, pad):
    out, n = B.pad_to_multiple(abc(spark), divisor)
    assert n == pad and out.count() == 3 + pad
    assert col(out, "pos", "x") == [("abc" * 4)[i] for i in range(3 + pad)]
    assert col(B.unpad(out), "pos", "x") == list("abc")


def test_union_conflict_and_nan(spark):
    a = frame(spark, [(0, float("nan")), (1, 2.0)], "id long, v double")
    assert B.union_columns(a, a.withColumn("w", F.lit(1)), "id").count() == 2
    with pytest.raises(Exception, match="differs"):
        B.union_columns(a, a.withColumn("v", F.lit(3.0)), "id").collect()
    with pytest.raises(ValueError):
        B.union_meta({"a": 1}, {"a": 2})


def test_pop(spark):
    a, rest = B.pop(abc(spark), ["x"])
    assert a.columns == ["x"] and rest.columns == ["pos"]
    with pytest.raises(KeyError):
        B.pop(abc(spark), ["nothing"])


def test_with_pos_is_dense(spark):
    df = B.with_pos(spark.range(1000).select((F.lit(999) - F.col("id")).alias("k")), "k")
    assert df.where("pos <> k").count() == 0 and df.count() == 1000


def test_reduce_metrics(spark):
    df = frame(spark, [("loss", 1.0), ("loss", 2.0), ("loss", 3.0), ("len/max", 1.0), ("len/max", 9.0), ("a_min", 4.0), ("a_min", 2.0)], "name string, value double")
    assert dict(M.reduce_metrics(df).collect()) == {"loss": 2.0, "len/max": 9.0, "a_min": 2.0}


def test_expected_extreme_is_the_order_statistic(spark):
    df = frame(spark, [("u", float(i)) for i in range(1, 6)], "g string, x double")
    assert M.expected_extreme(df, ["g"], "x", 3).first()["value"] == pytest.approx(5 - sum((i / 5) ** 3 for i in range(5)))
    b = M.bootstrap(df, "g", "x", 3).first()
    assert b["best_mean"] == pytest.approx(4.2, abs=0.15)


def test_majority_vote(spark):
    df = frame(spark, [("g", "A", 0.9, 0), ("g", "B", 0.8, 1), ("g", "A", 0.1, 2), ("h", "B", 0.7, 0), ("h", "A", 0.6, 1)], "g string, v string, s double, i long")
    assert dict(M.majority_value(df, ["g"], "v", "s", "i").collect()) == {"g": 0.9, "h": 0.7}


def test_grpo(spark):
    df = frame(spark, [(0, 0, 1.5), (1, 0, 3.0), (2, 1, 0.7), (3, 1, 2.3), (4, 2, 5.0)], "id long, uid long, s double")
    a = col(G.grpo(df), "id", "advantage")
    assert a[:4] == pytest.approx([-math.sqrt(0.5), math.sqrt(0.5)] * 2, abs=1e-5) and a[4] == pytest.approx(5.0, abs=1e-4)
    with pytest.raises(Exception, match="two samples"):
        G.passk(df).collect()


def test_gae_ignores_masked_values(spark):
    m = [0.0, 0.0, 1.0, 1.0, 0.0, 1.0]
    out = []
    for junk in (0.0, 77.0):
        v = [x if k else junk for x, k in zip([0.1, 0.2, 0.3, 0.4, 0.5, 0.6], m)]
        r = [0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
        df = frame(spark, [(r, v, m)], "r array<double>, v array<double>, m array<double>")
        got = df.select(K.gae(F.col("r"), F.col("v"), F.col("m"), 0.9, 0.8).alias("a")).first()["a"]
        out.append([x for x, k in zip(got, m) if k])
    assert out[0] == pytest.approx(out[1])


def test_masked_mean(spark):
    df = frame(spark, [(1.0, True), (float("nan"), False), (3.0, False), (4.0, True)], "x double, m boolean")
    assert df.agg(K.masked_mean(F.col("x"), F.col("m"))).first()[0] == pytest.approx(2.5)


def test_response_mask(spark):
    ids = [20, 10, 34, 1, 0, 0, 1]
    df = frame(spark, [(0, i, x == 1) for i, x in enumerate(ids)], "row_id long, pos long, eos boolean")
    assert col(df.withColumn("m", K.response_mask(F.col("eos"))), "pos", "m") == [1, 1, 1, 1, 0, 0, 0]


@pytest.mark.parametrize("equal", [False, True])
def test_balanced_parts(equal):
    sizes = [5, 9, 1, 7, 3, 8, 2, 6]
    loads = lambda parts: [sum(sizes[i] for i in p) for p in parts]
    for f in (balance.largest_differencing, balance.greedy):
        parts = f(sizes, 4, equal)
        assert sorted(i for p in parts for i in p) == list(range(8))
        assert not equal or all(len(p) == 2 for p in parts)
    best = loads(balance.largest_differencing(sizes, 4, equal))
    assert max(best) - min(best) <= max(sizes)
    # items in order, each to the lightest part; with equal counts, to the lightest of those with fewest items
    assert loads(balance.greedy(sizes, 4, equal)) == ([13, 15, 4, 9] if equal else [13, 9, 12, 7])


def test_registry():
    r = Registry("thing")
    f = r.register("a")(test_registry)
    assert r.register("a")(test_registry) is f
    with pytest.raises(ValueError):
        r.register("a")(print)
    with pytest.raises(KeyError):
        r.get("A")


def test_text_functions(spark):
    df = frame(spark, [("so \\boxed{\\frac{1}{2}} end", "<answer> x </answer> <answer>The Cat!</answer>", "#### 1,234")], "b string, a string, n string")
    r = df.select(X.last_boxed_balanced(F.col("b")).alias("b"), X.last_answer(F.col("a")).alias("a"), X.gsm8k_answer(F.col("n")).alias("n"), X.exact_match(F.lit("the cat"), F.array(F.lit("A cat."))).alias("m")).first()
    assert tuple(r) == ("\\frac{1}{2}", "The Cat!", "1234", 1)
    assert X.rpn("(1 + 2) * 3") == 9 and X.rpn("1 +") is None and X.repetitiveness("a") == 0


def test_unknown_source_is_an_error(spark):
    df = frame(spark, [("nowhere", "r", "g")], "data_source string, response string, ground_truth string")
    with pytest.raises(Exception, match="no scorer"):
        scoring.score(df).collect()


def test_tree_merge_and_lookup(spark):
    df = frame(spark, [("v", i, c) for i, c in enumerate("abcde")], "k string, i long, t string")
    assert curation.tree_merge(df, "k", "i", "t").first()["merged"] == "a+b+c+d+e"


def test_sources_round_trip(spark, tmp_path):
    p = tmp_path / "a.srt"
    p.write_text("1\n00:00:01,500 --> 00:00:03,000\nHello\nyou\n\n2\n00:01:00,000 --> 00:01:01,250\nBye\n")
    assert [tuple(r) for r in io.read_srt(spark, str(p)).orderBy("start").collect()] == [(1.5, 3.0, "Hello\nyou"), (60.0, 61.25, "Bye")]
    (tmp_path / "list.txt").write_text("# c\n\n a.mp4\n")
    assert [r.path for r in io.read_list(spark, str(tmp_path / "list.txt")).collect()] == ["a.mp4"]
    steps = tmp_path / "steps"
    steps.mkdir()
    (steps / "7.jsonl").write_text('{"output": "x<pad>y", "score": 1.0}\n')
    assert tuple(io.read_steps(spark, str(steps), ["<pad>"]).select("step", "output").first()) == (7, "xy")
    sink = io.MetricSink(spark, str(tmp_path / "m"))
    sink.log({"loss": 1.0, "acc": 0.5}, 3)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_streaming_accumulation(spark, tmp_path):
    data, ck = tmp_path / "in", tmp_path / "ck"
    for i in range(3):
        frame(spark, [("k", i * 10 + j) for j in range(5)], "key string, row long").coalesce(1).write.mode("append").parquet(str(data))
    seen = []
    stream = stateful.accumulate(stateful.read_growing(spark, str(data), "key string, row long"), "key", "row", 4)
    stateful.run_steps(stream, lambda df, i: seen.extend(df.collect()), str(ck))
    assert [r.batch for r in seen] == [0, 1, 2] and all(len(r.rows) == 4 for r in seen)


def test_token_bucket():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    b = stateful.TokenBucket(60, clock=lambda: now[0], sleep=sleep)
    for _ in range(61):
        b.take()
    assert sum(slept) == pytest.approx(1.0)
