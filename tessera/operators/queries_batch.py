"""Queries of the batch algebra, shards, shapes and orders (P, U, X, T, J1) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import batch as B
from tessera.operators.search import vector_topk
from tessera.plans.registry import Tables, query

OP = "op AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)"


def orders(t: Tables):
    return B.with_pos(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), "o_orderkey")


@query("p1_select", "SELECT o_orderkey, o_orderstatus FROM orders")
def p1(t):
    return B.select(t.orders, ["o_orderkey", "o_orderstatus"])


@query("p2_pop", "SELECT o_orderkey, o_custkey FROM orders")
def p2(t):
    popped, rest = B.pop(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderstatus"])
    return rest


@query("p3_rename", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders")
def p3(t):
    return B.rename(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey", "o_totalprice"], ["id", "price"])


@query("p4_gather", f"WITH {OP} SELECT i.out_pos::BIGINT AS pos, o_orderkey FROM op JOIN (SELECT unnest([0,1,2,3]) AS out_pos, unnest([7,3,3,0]) AS pos) i ON op.pos = i.pos")
def p4(t):
    return B.take(orders(t).select("pos", "o_orderkey"), [7, 3, 3, 0])


@query("p4_mask", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000")
def p4m(t):
    return B.take_mask(t.orders, F.col("o_totalprice") > 1000).select("o_orderkey")


@query("p5_slice", f"WITH {OP} SELECT pos::BIGINT AS pos, o_orderkey FROM op WHERE pos >= 10 AND pos < 500 AND (pos - 10) % 7 = 0")
def p5(t):
    return B.slice_rows(orders(t), 10, 500, 7).select("pos", "o_orderkey")


@query("p6_index", f"WITH {OP} SELECT pos::BIGINT AS pos, o_orderkey FROM op WHERE pos = 42")
def p6(t):
    return B.take(orders(t), 42).select("pos", "o_orderkey")


@query("p7_reorder", f"WITH {OP} SELECT (n - 1 - pos)::BIGINT AS pos, o_orderkey FROM op")
def p7(t):
    o = orders(t).select("pos", "o_orderkey")
    n = o.count()
    return B.gather(o, o.select((F.lit(n - 1) - F.col("pos")).alias("out_pos"), "pos")).select("pos", "o_orderkey")


@query("p8_overlong_filter", "SELECT doc_id, len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents WHERE len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) <= 300")
def p8(t):
    n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return t.documents.select("doc_id", n.alias("n_tokens")).where("n_tokens <= 300")


@query("p9_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def p9(t):
    return t.orders.select("o_orderkey").orderBy("o_orderkey").limit(100)


@query("p10_strided_shard", f"WITH {OP} SELECT o_orderkey FROM op WHERE pos % 8 = 3")
def p10(t):
    return B.strided_shard(orders(t), 8, 3).select("o_orderkey")


@query("p11_contiguous_shard", f"WITH {OP} SELECT o_orderkey FROM op WHERE least(pos // (n // 7), 6) = 6")
def p11(t):
    o = orders(t)
    return B.contiguous_shard(o, t.orders.count(), 7, 6).select("o_orderkey")


@query("p12_modulo_shard", "SELECT url FROM (SELECT url, row_number() OVER (ORDER BY url, page_id) - 1 AS i FROM pages) WHERE i % 4 = 1")
def p12(t):
    return B.strided_shard(B.with_pos(t.pages.select("url", "page_id"), "url", "page_id"), 4, 1).select("url")


@query("p13_value_filter", "SELECT doc_id FROM documents WHERE lang = 'fr' AND source = 'src3'")
def p13(t):
    return t.documents.where("lang = 'fr' AND source = 'src3'").select("doc_id")


@query("p14_string_date_range", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1995-03-00' AND strftime(o_orderdate, '%Y-%m-%d') < '1996-01-00'")
def p14(t):
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).where("day >= '1995-03-00' AND day < '1996-01-00'")


@query("p15_positive_duration", "SELECT event_id, value FROM events WHERE value > 0")
def p15(t):
    return t.events.where("value > 0").select("event_id", "value")


@query("p17_threshold", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality >= 0.85")
def p17(t):
    return t.documents.join(t.labels, "doc_id", "left").where("quality >= 0.85").select("doc_id")


@query("p20_required_fields", "SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE l.quality IS NULL)::BIGINT AS rejected FROM documents d LEFT JOIN labels l USING (doc_id)")
def p20(t):
    return t.documents.join(t.labels, "doc_id", "left").agg(F.count("*").alias("total"), F.count_if(F.col("quality").isNull()).alias("rejected"))


@query("p26_unpivot", "SELECT o_orderkey, 'q' || (k + 1) AS slot, CASE k WHEN 0 THEN o_custkey::VARCHAR WHEN 1 THEN o_orderstatus ELSE o_orderpriority END AS value FROM orders, (SELECT unnest([0, 1, 2]) AS k)")
def p26(t):
    return t.orders.selectExpr("o_orderkey", "stack(3, 'q1', cast(o_custkey as string), 'q2', o_orderstatus, 'q3', o_orderpriority) as (slot, value)")


@query("p27_option_permutation", "SELECT p_partkey, translate(substr(p_brand, 7, 1), '1234', 'BADC') AS answer FROM part")
def p27(t):
    return t.part.select("p_partkey", F.translate(F.substring("p_brand", 7, 1), "1234", "BADC").alias("answer"))


@query("p28_seeded_option_shuffle", "SELECT p_partkey, list_position(list_transform(list_sort(list_transform(['a','b','c','d'], lambda x: md5('7|' || p_partkey || '|' || x) || x)), lambda y: y[33:33]), 'a')::BIGINT AS answer_at FROM part")
def p28(t):
    keyed = F.array_sort(F.transform(F.array(*map(F.lit, "abcd")), lambda x: F.concat(F.md5(F.concat(F.lit("7|"), F.col("p_partkey").cast("string"), F.lit("|"), x).cast("binary")), x)))
    return t.part.select("p_partkey", F.array_position(F.transform(keyed, lambda y: F.substring(y, 33, 1)), "a").cast("long").alias("answer_at"))


@query("j1_union_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def j1(t):
    return B.union_columns(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")


@query("u1_concat", "SELECT o_orderkey, 0 AS part FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderstatus = 'O'")
def u1(t):
    return B.concat([t.orders.where(f"o_orderstatus = '{s}'").select("o_orderkey") for s in "FO"])


@query("u2_dataset_concat", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def u2(t):
    return t.documents.select(F.col("doc_id").alias("id"), "text").unionByName(t.benchmark.select(F.col("item_id").alias("id"), "text"))


@query("u3_repeat_interleave", f"WITH {OP} SELECT (pos * 3 + k)::BIGINT AS pos, o_orderkey FROM op, (SELECT unnest([0,1,2]) AS k)")
def u3(t):
    return B.repeat(orders(t), 3).select("pos", "o_orderkey")


@query("u3_repeat_tile", f"WITH {OP} SELECT (k * n + pos)::BIGINT AS pos, o_orderkey FROM op, (SELECT unnest([0,1]) AS k)")
def u3t(t):
    return B.repeat(orders(t), 2, interleave=False).select("pos", "o_orderkey")


@query("u4_repeat_by_count", "SELECT c_custkey, k::INTEGER AS copy FROM customer, (SELECT unnest(range(1, 5)) AS k) WHERE k <= c_custkey % 4")
def u4(t):
    return B.repeat_by(t.customer.withColumn("times", F.col("c_custkey") % 4), "times").select("c_custkey", "copy")


@query("u5_unfold_columns", "SELECT vec_id, c AS chunk, list_sum(embedding[c * 16 + 1:c * 16 + 16])::DOUBLE AS total FROM (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 3)) AS embedding, unnest([0,1,2,3]) AS c FROM embeddings)")
def u5(t):
    e = t.embeddings.select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 3)).alias("embedding"))
    return B.unfold_columns(e, 4, ["embedding"]).select("vec_id", "chunk", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("u6_fold", f"WITH {OP} SELECT (pos // 5)::BIGINT AS pos, string_agg(o_orderkey::VARCHAR, ',' ORDER BY pos) AS keys FROM op GROUP BY 1")
def u6(t):
    return B.fold(orders(t), 5, ["o_orderkey"]).select("pos", F.array_join(F.col("o_orderkey").cast("array<string>"), ",").alias("keys"))


@query("u6_unfold", f"WITH {OP} SELECT pos::BIGINT AS pos, o_orderkey FROM op")
def u6u(t):
    return B.unfold(B.fold(orders(t), 5, ["o_orderkey"]), 5, ["o_orderkey"]).select("pos", "o_orderkey")


@query("u7_pad_to_multiple", f"WITH {OP} SELECT pos::BIGINT AS pos, o_orderkey, false AS is_pad FROM op UNION ALL SELECT pos + n, o_orderkey, true FROM op WHERE pos < (64 - n % 64) % 64")
def u7(t):
    return B.pad_to_multiple(orders(t), 64)[0].select("pos", "o_orderkey", "is_pad")


@query("u8_pad_edge", f"WITH {OP} SELECT pos::BIGINT AS pos, o_orderkey FROM op UNION ALL SELECT n + k, o_orderkey FROM op, (SELECT unnest([0,1,2]) AS k) WHERE pos = n - 1")
def u8(t):
    return B.pad_with_edge(orders(t), 3).select("pos", "o_orderkey")


@query("u10_distinct", "SELECT DISTINCT event_type FROM events")
def u10(t):
    return t.events.select("event_type").distinct()


@query("u11_seeded_split", "SELECT doc_id, CASE WHEN k <= floor(n * 0.9) THEN 'train' ELSE 'test' END AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('3|' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM documents)")
def u11(t):
    d = B.with_pos(t.documents.select("doc_id", B.seeded_order("doc_id", seed=3).alias("k")), "k", "doc_id")
    return d.select("doc_id", F.when(F.col("pos") + 1 <= F.floor(F.lit(t.documents.count() * 0.9)), "train").otherwise("test").alias("part"))


@query("x1_chunk", f"WITH {OP} SELECT o_orderkey, (pos // (n // 5))::BIGINT AS chunk FROM op")
def x1(t):
    n = t.orders.count()
    return orders(t).select("o_orderkey", B.chunk_of(F.col("pos"), n, 5).alias("chunk"))


@query("x2_split", f"WITH {OP} SELECT o_orderkey, (pos // 64)::BIGINT AS chunk FROM op")
def x2(t):
    return orders(t).select("o_orderkey", B.split_of(F.col("pos"), 64).alias("chunk"))


@query("x3_minibatches", "SELECT doc_id, e::INTEGER AS epoch, ((row_number() OVER (PARTITION BY e ORDER BY md5('5|' || e || '|' || doc_id), doc_id) - 1) // 32)::BIGINT AS batch FROM documents, (SELECT unnest([0, 1]) AS e)")
def x3(t):
    return B.minibatches(t.documents.select("doc_id"), 32, 2, 5, "doc_id")


@query("x8_restore", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey)::BIGINT - 1 AS pos FROM orders")
def x8(t):
    o = orders(t).select("pos", "o_orderkey")
    moved = o.withColumn("out_pos", (F.col("pos") * 7919) % F.lit(1 << 31))
    return moved.select("o_orderkey", "pos")


@query("x13_curriculum_order", "SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id)::BIGINT - 1 AS pos FROM documents")
def x13(t):
    return B.with_pos(t.documents.select("doc_id", "n_chars"), "n_chars", "doc_id").select("doc_id", "pos")


@query("x14_distributed_sampler", "SELECT doc_id, (k % 4)::BIGINT AS rank FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('9|' || doc_id), doc_id) - 1 AS k, count(*) OVER () AS n FROM documents) WHERE k < n // 4 * 4")
def x14(t):
    n = t.documents.count()
    d = B.with_pos(t.documents.select("doc_id", B.seeded_order("doc_id", seed=9).alias("k")), "k", "doc_id")
    return d.where(F.col("pos") < n // 4 * 4).select("doc_id", (F.col("pos") % 4).alias("rank"))


@query("t1_sort", "SELECT user_id, event_id, row_number() OVER (ORDER BY user_id, ts, event_id)::BIGINT - 1 AS pos FROM events")
def t1(t):
    return B.with_pos(t.events.select("user_id", "ts", "event_id"), "user_id", "ts", "event_id").select("user_id", "event_id", "pos")


@query("t7_coalesced_sort", "SELECT doc_id, coalesce(toxic, quality, 0) AS s, row_number() OVER (ORDER BY coalesce(toxic, quality, 0) DESC, doc_id)::BIGINT - 1 AS pos FROM documents LEFT JOIN labels USING (doc_id)")
def t7(t):
    d = t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("toxic", "quality", F.lit(0)).alias("s"))
    return B.with_pos(d.withColumn("k", -F.col("s")), "k", "doc_id").select("doc_id", "s", "pos")


@query("t10_vector_topk", """WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), x AS (SELECT query, vec_id AS neighbour, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q)
SELECT query, neighbour, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS rank FROM x) WHERE rank <= 10""")
def t10(t):
    return vector_topk(t.embeddings.where("vec_id % 20 = 0"), t.embeddings, "vec_id", "embedding", 10)
