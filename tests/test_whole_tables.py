"""Queries take whole tables."""

from itertools import groupby

from pyspark.sql import functions as F

from tessera import catalog


def test_adjacent_merge_of_all_users(spark, tmp_path):
    rows = [(i, i % 60, "abc"[i * i // 60 % 3]) for i in range(600)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    events = spark.read.parquet(f"{tmp_path}/events.parquet").orderBy("user_id", "event_id").select("user_id", "event_type").collect()
    want = {(user, i): list(run) for user, rows in groupby(events, lambda r: r.user_id) for i, run in enumerate(list(x) for _, x in groupby([r.event_type for r in rows]))}
    got = {(r.user_id, r.event): list(r.captions) for r in catalog.QUERIES["w19_adjacent_merge"](spark, str(tmp_path)).collect()}
    assert got == want


def test_no_rows_left_out(spark, sf):
    n = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("events", "documents")}
    assert catalog.QUERIES["s7_json_round_trip"](spark, sf).count() == n["events"]
    assert catalog.QUERIES["a39_append_to_dict"](spark, sf).agg(F.sum(F.size(F.split("ids", ",")))).first()[0] == n["events"]
    assert catalog.QUERIES["t7_coalesced_sort"](spark, sf).count() == n["documents"]
