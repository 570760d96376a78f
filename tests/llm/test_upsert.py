"""Keyed upserts against a brute-force version that works on lists of rows."""

import hashlib
import random
import zlib

import pandas as pd
import pytest

from tessera.llm import queries, upsert

CLIENT = "client_id long, master_id long, source string, updated_at timestamp, name string, email string, city string, nation_id int, segment string, balance double"
CHANGE = "change_id long, client_id long, seq long, op string, valid_at timestamp, source string, segment string, city string, balance double"
SET = ["source", "segment", "city", "balance"]


def crc(x):
    return zlib.crc32(str(x).encode())


def value(x):
    return None if x is None or x != x else x


def cut(rows, most):
    """Rows in the fewest parts of at most ``most``, sizes at most one apart, larger first."""
    k = -(-len(rows) // most)
    out, at = [], 0
    for i in range(k):
        n = len(rows) // k + (i < len(rows) % k)
        out.append(rows[at : at + n])
        at += n
    return out


def brute(clients, changes):
    most = 1 + len(clients) // 700
    held = sorted((r for r in clients if r["client_id"] is not None and crc(r["client_id"]) % 7 > 3), key=lambda r: r["client_id"])
    files = [held[i : i + most] for i in range(0, len(held), most)]
    if not files:
        return []
    firsts = [f[0]["client_id"] for f in files]
    last = {}
    for c in changes:
        if c["client_id"] is not None:
            rank = lambda c: (c["seq"] is not None, c["seq"] or 0, c["change_id"] is not None, c["change_id"] or 0)
            if c["client_id"] not in last or rank(c) >= rank(last[c["client_id"]]):
                last[c["client_id"]] = c
    now, touched = [{r["client_id"]: dict(r) for r in f} for f in files], set()
    for i, c in last.items():
        home = max((k for k, f in enumerate(firsts) if f <= i), default=0)
        h = crc(firsts[home]) % 12
        if h > 7:
            continue
        if c["op"] == "D" or c["change_id"] is not None and crc(c["change_id"]) % 8 < h:
            if i in now[home]:
                del now[home][i]
                touched.add(home)
        else:
            row = now[home].get(i) or dict.fromkeys(held[0]) | {"client_id": i, "new": 1}
            if "new" in row or any(value(row[x]) != value(c[x]) for x in SET):
                touched.add(home)
                row.pop("new", 0)
                now[home][i] = row | {x: c[x] for x in SET}
    out = []
    for k, rows in enumerate(now):
        rows = [rows[i] for i in sorted(rows)]
        for part in cut(rows, most) if k in touched else [rows]:
            if out and k in touched and out[-1][1] and len(out[-1][0]) + len(part) <= most:
                out[-1] = out[-1][0] + part, True
            else:
                out.append((part, k in touched))
    return [digest(rows, new) for rows, new in out]


def digest(rows, new):
    import math

    cents = sum(math.floor(100 * r["balance"] + 0.5) for r in rows if value(r["balance"]) is not None)
    text = lambda r: "|".join(r[c] or "" for c in SET[:3])
    return (rows[0]["client_id"], len(rows), cents, sum(zlib.crc32(text(r).encode()) for r in rows), hashlib.sha256(",".join(str(r["client_id"]) for r in rows).encode()).hexdigest(), new)


def run(spark, folder):
    out = queries.op11_keyed_upsert(spark, str(folder)).collect()
    assert len({r["path"] for r in out}) == len(out)
    for r in out:
        assert r["columns"] == ",".join(x.split()[0] for x in CLIENT.split(", ")) + r["columns"][len(",".join(x.split()[0] for x in CLIENT.split(", "))) :]
        ids = pd.read_parquet(r["path"].replace("file://", ""))["client_id"]
        assert list(ids) == sorted(ids) and len(ids) == r["n_rows"]
    if out:
        left = upsert.pq.ParquetDataset(out[0]["path"].replace("file://", "").rpartition("/")[0]).files
        assert len(left) == len(out)
    return sorted((r["first_id"], r["n_rows"], r["cents"], r["rows_crc"], r["ids_sha256"], r["rewritten"]) for r in out)


def as_rows(df):
    return [r.asDict() for r in df.collect()]


def test_upsert_of_the_tables(spark, sf):
    clients, changes = (as_rows(spark.read.parquet(f"{sf}/{t}.parquet")) for t in ("clients", "client_changes"))
    assert run(spark, sf) == sorted(brute(clients, changes))


@pytest.mark.parametrize("seed", range(2))
def test_upsert_of_random_rows(spark, tmp_path, seed):
    """Files of several rows, nulls everywhere, keys before the first file and after the last, repeated changes, runs of small files, an extra column that clashes."""
    rng = random.Random(seed)
    maybe = lambda x: None if rng.random() < 0.15 else x
    word = lambda: maybe(rng.choice(["a", "b", "ü|"]))
    clients = [(i, maybe(1), word(), None, word(), None, word(), maybe(3), word(), maybe(rng.choice([1.005, -2.5, 0.0])), "x") for i in rng.sample(range(100, 9000), 2900)]
    changes = [(rng.randrange(4000), maybe(rng.choice([rng.randrange(-50, 9100), 77])), maybe(rng.randrange(5)), maybe(rng.choice("UUDDI")), None, word(), word(), word(), maybe(rng.choice([1.005, 7.0]))) for _ in range(3000)]
    changes = list({(c[1], c[2], c[0]): c for c in changes}.values())
    same = [(9000 + k, c[0], 9, "U", None, c[2], c[8], c[6], c[9]) for k, c in enumerate(clients[:1500])]  # nothing changes
    spark.createDataFrame(clients, CLIENT + ", path string").write.parquet(f"{tmp_path}/clients.parquet")
    spark.createDataFrame(changes + same + same[:50], CHANGE).write.parquet(f"{tmp_path}/client_changes.parquet")
    clients, changes = (as_rows(spark.read.parquet(f"{tmp_path}/{t}.parquet")) for t in ("clients", "client_changes"))
    want = sorted(brute(clients, changes))
    assert run(spark, tmp_path) == want
    assert {x[-1] for x in want} == {True, False}


@pytest.mark.parametrize("with_changes", [False, True])
def test_upsert_of_empty_tables(spark, sf, tmp_path, with_changes):
    """No rows: no files, whatever the changes; no changes: the starting files."""
    clients, changes = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("clients", "client_changes"))
    clients.limit(10 ** 6 * (not with_changes)).write.parquet(f"{tmp_path}/clients.parquet")
    changes.limit(10 ** 6 * with_changes).write.parquet(f"{tmp_path}/client_changes.parquet")
    assert run(spark, tmp_path) == sorted(brute(as_rows(spark.read.parquet(f"{tmp_path}/clients.parquet")), as_rows(spark.read.parquet(f"{tmp_path}/client_changes.parquet"))))


def test_filters_and_fences_prune_absent_keys(spark):
    """No key of a file is missed; of deletes of absent keys few remain before the exact join."""
    from pyspark.sql import functions as F

    files = upsert.KeyedFiles(spark, "k", 500).start(spark.range(5000).select((F.col("id") * 3).alias("k"), F.lit("v").alias("v")))
    assert [r["n"] for r in files.files().orderBy("first").collect()] == [500] * 10
    gone = F.struct(F.lit(True).alias("gone"), F.lit("w").alias("v"))
    routed = files.route(spark.range(-3000, 18000).select("id", gone.alias("change")))
    left = files._remaining(routed)
    assert left.where("id % 3 = 0 and id between 0 and 14999").count() == 5000
    assert left.where("id % 3 <> 0").count() < 200 and left.where("id < 0").count() == 0
    # a second upsert works on the files that the first one left
    files.apply(routed.where("id % 6 = 0"), ["v"])
    again = files.route(spark.range(0, 300).select("id", F.struct(F.lit(False).alias("gone"), F.lit("w").alias("v")).alias("change")))
    files.apply(again, ["v"])
    rows = files.rows().select("id", "row.v")
    assert rows.where("v = 'w'").count() == 300 and rows.count() == 2500 + 300 - 50
    assert files._remaining(files.route(spark.range(0, 300).select("id", gone.alias("change")))).count() == 300
