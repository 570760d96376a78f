"""Places and ranks of a balanced reorder: as the lists say, groups in common batches, keys of any kind."""

from tessera import catalog
from tessera.operators import dispatch as D
from test_greedy_partitions import size


def test_partition_lists_of_large_ids(spark, tmp_path):
    first = (0, 589_457, 5_999_992, 4_000_000_000)
    spark.createDataFrame([(i + k, u) for u, i in enumerate(first) for k in range(11)], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    want = {i + k: rank for i in first for rank, part in enumerate(D.partition_lists([size(i + k) for k in range(8)], 4, True)) for k in part}
    out = catalog.QUERIES["x6_partition_lists"](spark, str(tmp_path))
    assert {r.event_id: r["rank"] for r in out.collect()} == want
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


def test_reorder_of_a_group_without_key(spark):
    rows = [(None, x, s) for x, s in zip("abcd", (5, 1, 2, 4))] + [("g", x, s) for x, s in zip("dcba", (1, 1, 9, 3))]
    out = D.balance_reorder(spark.createDataFrame(rows, "g string, x string, n int"), "g", "x", "n", 2).collect()
    for g in (None, "g"):
        own = sorted((x, s) for k, x, s in rows if k == g)
        lists = D.partition_lists([s for _, s in own], 2, True)
        want = [(own[i][0], rank) for rank, part in enumerate(lists) for i in part]
        assert [(r.x, r["rank"]) for r in sorted((r for r in out if r.g == g), key=lambda r: r.place)] == want
