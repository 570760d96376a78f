"""Greedy partitions of many small groups with ids beyond half a million: exact sizes, groups in common batches."""

from tessera import catalog
from tessera.operators import balance


def size(i):
    return (i * i * 26544357 + i * 12345) % 1000000007 + 1


def test_greedy_partitions_of_large_ids(spark, tmp_path):
    first = (0, 589_457, 5_999_992, 4_000_000_000)
    spark.createDataFrame([(i + k, u) for u, i in enumerate(first) for k in range(11)], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for i in first:  # three rows of each user fill no batch
        sizes = [size(i + k) for k in range(8)]
        for part in balance.greedy(sizes, 4, True):
            want |= {i + k: sum(sizes[j] for j in part) for k in part}
    out = catalog.QUERIES["x5_greedy_partitions"](spark, str(tmp_path))
    assert {r.event_id: r.load for r in out.collect()} == want
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()  # a frame for each group of eight rows
