"""Calls on long prompts come in Arrow batches of some MB."""

import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import curation as C


def test_long_prompts_come_in_small_batches(spark):
    prompts = spark.range(0, 48, 1, 1).select("id", F.repeat(F.lit("x"), 1 << 20).alias("prompt"))
    asked = C.pipeline_call(prompts, lambda p: str(len(p)), "prompt", "reply")
    assert {r.reply for r in asked.select("reply").collect()} == {str(1 << 20)}
    rows = F.pandas_udf(lambda s: pd.Series([len(s)] * len(s)), "long")
    assert prompts.select(rows("prompt").alias("n")).agg(F.max("n")).first()[0] <= 8
