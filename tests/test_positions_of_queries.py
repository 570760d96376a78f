"""Positions of the queries that number sorted rows, on tables larger than a range sort's sample, against their SQL."""

import oracle
import pytest
from pyspark.sql import functions as F

from tessera import catalog

N = 40_000


@pytest.fixture
def against_sql(spark, tmp_path):
    """Check of a query on tables of several files; small partitions stay apart and a sort that two steps use may run twice, as with large ones."""

    def check(name, **tables):
        for table, df in tables.items():
            df.write.parquet(f"{tmp_path}/{table}.parquet")
        oracle.check(spark, oracle.connect(tmp_path), str(tmp_path), name, catalog.QUERIES[name], catalog.ORACLES[name])

    for key in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.exchange.reuse"):
        spark.conf.set(key, "false")
    yield check
    for key in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.exchange.reuse"):
        spark.conf.unset(key)


def mixed(spark):
    """0..N-1 in another order, in five parts."""
    return spark.range(0, N, 1, 5).select((F.col("id") * 7919 % N).alias("k"))


def test_pairs_of_preference_batch(spark, against_sql):
    lines = mixed(spark).select(
        F.col("k").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(1).alias("l_partkey"), F.lit(1).alias("l_suppkey"), F.lit(1.5).alias("l_extendedprice"), F.lit("2020-01-01").alias("l_shipdate"),
        (F.col("k") % 9 / 100).alias("l_tax"), F.lit(0.04).alias("l_discount"), F.lit(7.0).alias("l_quantity"), F.lit("N").alias("l_returnflag"), F.lit("O").alias("l_linestatus"),
    )
    against_sql("j15_preference_batch", lineitem=lines)


def test_places_of_coalesced_sort(spark, against_sql):
    labels = mixed(spark).where("k % 3 > 0").select(F.col("k").alias("doc_id"), (F.col("k") % 2).cast("int").alias("quality"), F.when(F.col("k") % 5 > 0, (F.col("k") % 7 > 3).cast("int")).alias("toxic"))
    against_sql("t7_coalesced_sort", documents=mixed(spark).select(F.col("k").alias("doc_id")), labels=labels)


def test_places_and_edge_of_padded_orders(spark, against_sql):
    orders = mixed(spark).select(F.col("k").alias("o_orderkey"), (F.col("k") % 11).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), (F.col("k") / 4).alias("o_totalprice"))
    against_sql("u8_pad_edge", orders=orders)


def events(spark):
    k = F.col("k")
    return mixed(spark).select(k.alias("event_id"), (k % 60).alias("user_id"), (k * 31 % 101 / 8).alias("value"), F.lit("{}").alias("props"), F.substring(F.lit("abc"), (k * k / 60 % 3 + 1).cast("int"), F.lit(1)).alias("event_type"), k.alias("ts"))


def test_runs_of_consecutive_rloo(spark, against_sql):
    against_sql("w10_consecutive_rloo", events=events(spark))


def test_ordinals_of_rollouts(spark, against_sql):
    against_sql("w13_rollout_ordinal", events=events(spark))
