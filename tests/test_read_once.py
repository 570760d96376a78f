"""Parsers and packs work a reply out once, however many patterns or packs use it."""

from pyspark.sql import functions as F

from tessera.functions import choices as H
from tessera.plans.packs import Measure, Pack, evaluate


def test_choice_parsers_trim_a_reply_once(spark):
    letters = F.array(*map(F.lit, "ABCD"))
    for parse in (H.parse_brackets, H.parse_periods):
        made = parse(F.col("reply"), letters, F.array(*map(F.lit, ("no 1", "no 2", "no 3", "no 4"))))
        assert str(made).count("reply") <= 3  # the reply itself, and the two fixed replies of parse_periods


def test_each_pack_is_read_once(spark):
    df = spark.createDataFrame([(1, "A"), (2, "B")], "k int, reply string")
    hit = lambda a: F.coalesce(a == "A", F.lit(False))
    one = Pack("one", hit, [F.regexp_extract("reply", "[AB]", 0)], lambda s: [Measure("acc", s)])
    steps = Pack("steps", hit, [F.regexp_extract("reply", "[CD]", 0)], lambda m: [Measure("some", F.size(m))], unit=F.col("k"), step=F.lit("x"))
    out = evaluate(df, [one, steps])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[AB]") == plan.count("[CD]") == 1
    assert {(r["pack"], r["value"], r["n"]) for r in out.collect()} == {("one", 0.5, 2), ("steps", 1.0, 2)}


def test_last_places_and_ends_of_odd_texts(spark):
    texts = ["", "a", "aaa", "ba ab", "日本日本", "\t\n\x0b\f\r x   \n", " \n ", "😀a😀", None]
    rows = [(x, n) for x in texts for n in ("", "a", "aa", "日本", "😀", " ", None)]
    got = spark.createDataFrame(rows, "x string, n string").select("x", "n", H.rfind(F.col("x"), F.col("n")).alias("at"), H.strip(F.col("x")).alias("s")).collect()
    for r in got:
        assert r.at == (-1 if r.x is None or r.n is None else r.x.rfind(r.n)), (r.x, r.n)
        assert r.s == (None if r.x is None else r.x.strip(" \t\n\x0b\f\r"))
