"""Values that round to zero keep the sign that the SQL gives them."""

import oracle

from tessera import catalog


def test_zero_advantages_of_consecutive_rloo(spark, tmp_path):
    values = [1.0, 1.0, 1.0, 1.0000001, 2.0, 2.0, 2.0, 1.9999999, 3.0, 5.0]
    rows = [(i, i % 2, v, "{}", "a", i) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double, props string, event_type string, ts long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    want = {i: str(x) for i, x in oracle.connect(tmp_path).sql(catalog.ORACLES["w10_consecutive_rloo"]).fetchall()}
    got = {r.id: str(r.advantage) for r in catalog.QUERIES["w10_consecutive_rloo"](spark, str(tmp_path)).collect()}
    assert {"0.0", "-0.0"} < set(want.values())
    assert got == want
