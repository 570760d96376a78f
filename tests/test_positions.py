"""Positions and sizes on tables larger than a sort's sample, and ids beyond half a million."""

from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import batch as B


def test_positions_are_dense_beyond_the_sample(spark):
    n = 40_000
    rows = spark.range(0, n, 1, 5).select((F.col("id") * 7919 % n).alias("k"), F.md5(F.col("id").cast("string")).alias("more"), (F.col("id") % 3).alias("third"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart, as large ones do
    try:
        _dense(B.with_pos(rows, "k"), n)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _dense(placed, n):
    rows = placed.collect()  # all columns: the counts alone would read a narrower sort
    assert sorted(r.pos for r in rows) == list(range(n))
    assert all(r.pos == r.k for r in rows)


def test_sizes_of_large_ids(spark, tmp_path):
    ids = [k + s for s in (0, 589_457, 5_999_992, 4_000_000_000) for k in range(8)]
    spark.createDataFrame([(i, n // 8) for n, i in enumerate(ids)], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    size = {i: (i * i * 26544357 + i * 12345) % 1000000007 + 1 for i in ids}
    for name in ("x4_balanced_partitions", "x5_greedy_partitions"):
        loads = {r.event_id: r.load for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
        assert set(loads) == set(ids)
        for u in range(4):
            own = ids[8 * u : 8 * u + 8]
            assert all(any(size[i] + size[j] == loads[i] for j in own if j != i) for i in own)
    places = catalog.QUERIES["x9_balance_reorder"](spark, str(tmp_path)).collect()
    assert sorted(r.event_id for r in places) == sorted(ids)
    assert catalog.QUERIES["x6_partition_lists"](spark, str(tmp_path)).count() == len(ids)
