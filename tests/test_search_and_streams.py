"""Vector search against brute force; stateful streams against sequential models, over restarts."""

from collections import OrderedDict

import numpy as np
import pytest

from tessera import catalog
from tessera.operators import search
from tessera.streaming import stateful


@pytest.mark.parametrize("block, k", [(1 << 16, 5), (50, 5), (7, 1), (64, 400)])
def test_vector_topk(spark, monkeypatch, block, k):
    """Ties, repeated vectors, nulls, zeros, another length; blocks smaller than k, more places than vectors."""
    rng = np.random.default_rng(block)
    vectors = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(300)] + [(300, None), (301, [0.0] * 4), (302, [1.0]), (None, [1.0] * 4), (303, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(vectors, "id long, v array<float>").repartition(3)
    queries = df.where("id % 20 = 0 or id > 299")
    usable = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors if i is not None and v is not None and len(v) == 4 and any(v)}
    want = {}
    for q in (i for i in usable if i % 20 == 0 or i > 299):
        ranked = sorted((-np.round(float(usable[q] @ v), 6), i) for i, v in usable.items())[:k]
        want[q] = [i for _, i in ranked]
    got = {}
    for r in search.vector_topk(queries, df, "id", "v", k, block=block).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["neighbour"])
    assert got == want
    assert search.vector_topk(queries, df.limit(0), "id", "v", k).count() == 0


class Sequential:
    """Routing as stated, by an ordered table that moves what is used to its end."""

    def __init__(self, servers, most):
        self.loads, self.table, self.most = [0] * servers, OrderedDict(), most

    def event(self, request, ends):
        if ends:
            if request not in self.table:
                return None
            entry = self.table[request]
            if entry[1]:
                entry[1] -= 1
                self.loads[entry[0]] -= 1
            return entry[0]
        if request not in self.table:
            server = self.loads.index(min(self.loads))
            if len(self.table) == self.most:
                old = self.table.popitem(last=False)[1]
                self.loads[old[0]] -= old[1]
            self.table[request] = [server, 0]
        self.table.move_to_end(request)
        entry = self.table[request]
        entry[1] += 1
        self.loads[entry[0]] += 1
        return entry[0]


def test_routed_stream_equals_sequential_model(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").collect()
    routers, want = {}, {}
    for r in events:
        router = routers.setdefault(r["user_id"] % 7, Sequential(3, 8))
        want[r["event_id"]] = router.event(str(r["user_id"]), r["event_type"] in ("signup", "purchase"))
    got = {r["event_id"]: r["server"] for r in catalog.QUERIES["x12_routed_stream"](spark, sf).collect()}
    assert got == want
    assert None in want.values() and len(set(want.values())) == 4


def test_router_keeps_and_forgets():
    r = stateful.Router(2, 2)
    assert [r.take(x) for x in "abab"] == [0, 1, 0, 1] and r.loads == [2, 2]
    assert r.release("a") == 0 and r.take("c") == 0 and list(r.known) == ["b", "c"]  # a goes with its turn in flight
    assert r.loads == [1, 2] and r.release("a") is None and r.release("b") == r.release("b") == r.release("b") == 1 and r.loads == [1, 0]


def test_accumulation_flushes_when_idle(spark, tmp_path):
    """A key that rests for longer than ``idle`` gives its leftovers before the input ends, and begins a new batch afterwards."""
    from pyspark.sql import functions as F

    at = lambda rows: spark.createDataFrame(rows, "k string, row long, s long").select("k", "row", F.timestamp_seconds("s").alias("ts")).coalesce(1)
    for rows in ([("a", i, 10 + i) for i in range(5)], [("b", 100, 1000)], [("a", 50, 1001), ("b", 101, 1002)]):
        at(rows).write.mode("append").parquet(f"{tmp_path}/in")
    stateful.end_of_input(at([("a", 1, 1)]), "ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []
    stream = stateful.accumulate(stateful.read_growing(spark, f"{tmp_path}/in", "k string, row long, ts timestamp"), "k", "row", 3, "ts", "10 seconds")
    stateful.run_steps(stream, lambda df, i: seen.extend(map(tuple, df.collect())), f"{tmp_path}/ck")
    assert sorted(seen) == [("a", 0, [0, 1, 2]), ("a", 1, [3, 4]), ("a", 2, [50]), ("b", 0, [100, 101])]
