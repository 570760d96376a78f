"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Both sides keep, of every window of ``n - k + 1`` consecutive k-gram hashes, the
smallest.  A span of ``n`` words that stands on both sides holds the same k-grams
there, hence the same minimum: joining the kept fingerprints misses no such span.
In documents that share a fingerprint with an item, every window whose own minimum is
among the items' fingerprints is extended to its whole length and compared by a 128-bit
digest of its words with the items' windows: work and rows are linear in the words of
both sides, also where one word repeats thousands of times.  Items of fewer than ``n``
words are one window of their whole length, and are their own fingerprint.

Words are compared in the Latin-1 reading of their UTF-8 bytes, in which lower-casing
touches A-Z and the lead bytes of longer characters alike on both sides; the number
of bytes that follow tells those leads apart, so equal forms mean equal words.

Defined results: null text or text without words has no hit; items with a null id or
without words take no part; rows that repeat an item_id count as one item; repeated
document rows each get a result row; further columns are ignored; on an empty
benchmark every document is clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import scratch as S

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    lowered = F.lower(F.decode(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), "ISO-8859-1"))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once for the row."""
    return F.transform(F.array(value), body)[0]


def gram_hashes(word_hashes: Column, k: int) -> Column:
    """Hash of every k consecutive words; nothing where fewer follow."""
    full = let(word_hashes, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)])))
    return let(full, lambda g: F.slice(g, 1, F.greatest(F.size(g) - (k - 1), F.lit(0))))


def window_values(grams: Column, width: int) -> Column:
    """Smallest of each ``width`` consecutive hashes (fewer at the end), place by place."""
    return let(grams, lambda g: F.transform(g, lambda x, i: F.least(x, *[F.get(g, i + j) for j in range(1, width)]) if width > 1 else x))


def window_minima(grams: Column, width: int) -> Column:
    """The distinct smallest hashes of each ``width`` consecutive ones (fewer at the end)."""
    return F.array_distinct(window_values(grams, width))


def every_window(values: Column, tail: int) -> Column:
    """Without the last ``tail`` places, from which no whole window starts."""
    return let(values, lambda v: F.slice(v, 1, F.greatest(F.size(v) - tail, F.lit(0))))


def window_keys(starts: Column, words: str, m: Column) -> Column:
    """(pos, key): the 128-bit digest of the ``m`` words from each start on."""
    return F.transform(starts, lambda p: F.struct(p.cast("int").alias("pos"), F.md5(F.array_join(F.slice(F.col(words), p + 1, m), " ").cast("binary")).alias("key")))


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def text_key() -> Column:
    """128-bit identity of a row of (doc_id, text)."""
    return S.row_key(F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(verdicts, hits): a row per document row, and (row_key, doc_id, item_id, pos, length) of every window of an item in a document."""
    scratch = S.Scratch(docs.sparkSession)
    items = benchmark.select("item_id", words_of("text").alias("words")).where(F.col("item_id").isNotNull() & (F.size("words") > 0)).distinct()
    items = scratch.write(items.withColumn("need", F.least(F.size("words"), F.lit(n))), "items")
    short = sorted(r[0] for r in items.where(F.col("need") < n).select("need").distinct().collect())  # fewer than n values

    def kept(h: Column) -> Column:
        """Fingerprints of a document: of its n-word windows, and of each length that a short item has."""
        return F.concat(window_minima(gram_hashes(h, k), n - k + 1), *[F.array_distinct(gram_hashes(h, m)) for m in short])

    key = text_key().alias("row_key")
    base = S.texts_of(docs).select("doc_id", key, hashes(words_of("text")).alias("h"))
    base = scratch.write(base.select("doc_id", "row_key", F.size("h").cast("long").alias("n_words"), kept(F.col("h")).alias("prints")), "prints")

    def item_prints(m: int, size: int) -> DataFrame:
        """The fingerprints of items of one length."""
        grams = gram_hashes(hashes(F.col("words")), size)
        return items.where(F.col("need") == m).select(F.explode(window_minima(grams, n - size + 1 if m == n else 1)).alias("print"))

    prints = item_prints(n, k)
    for m in short:
        prints = prints.unionByName(item_prints(m, m))
    hit_prints = S.small(scratch.write(prints.distinct(), "hit-prints"))
    suspects = base.select("row_key", F.explode("prints").alias("print")).join(hit_prints, "print", "left_semi").select("row_key").distinct()
    suspects = scratch.write(suspects, "suspects")
    texts = S.texts_of(docs).select("doc_id", key, words_of("text").alias("w")).join(S.small(suspects), "row_key", "left_semi").dropDuplicates(["row_key"])
    texts = scratch.write(texts.withColumn("h", hashes(F.col("w"))), "suspect-words")
    places = None  # of every window that starts at a place of a suspect: its fingerprint
    for m in [n, *short]:
        grams = gram_hashes(F.col("h"), k if m == n else m)
        prints_of = every_window(window_values(grams, n - k + 1), n - k) if m == n else grams
        own = texts.select("row_key", F.lit(m).alias("m"), F.posexplode(prints_of).alias("pos", "print"))
        places = own if places is None else places.unionByName(own)
    starts = places.join(hit_prints, "print", "left_semi").groupBy("row_key", "m").agg(F.collect_list("pos").alias("at"))
    starts = scratch.write(starts, "starts")
    sought = scratch.write(items.select("item_id", F.col("need").alias("m"), F.explode(window_keys(F.sequence(F.lit(0), F.size("words") - F.col("need")), "words", F.col("need"))).alias("x")).select("item_id", "m", "x.key").distinct(), "item-windows")
    windows = starts.join(texts.select("row_key", "doc_id", "w"), "row_key").select("row_key", "doc_id", "m", F.explode(window_keys(F.col("at"), "w", F.col("m"))).alias("x")).select("row_key", "doc_id", "m", "x.pos", "x.key")
    found = scratch.write(windows.join(S.small(sought.select("m", "key").distinct()), ["m", "key"], "left_semi"), "hit-windows")
    hits = found.join(S.small(sought), ["m", "key"]).select("row_key", "doc_id", "item_id", "pos", F.col("m").alias("length"))
    counts = found.select("row_key", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("m") - 1)).alias("pos")).distinct().groupBy("row_key").agg(F.count("*").alias("n_hit"))
    named = found.select("row_key", "m", "key").distinct().join(S.small(sought), ["m", "key"]).select("row_key", "item_id").distinct()
    named = named.groupBy("row_key").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.col("item_id").cast("string"))), ","), 256).alias("items_sha256"))
    per_doc = counts.join(named, "row_key")
    verdicts = base.drop("prints").join(S.small(scratch.write(per_doc, "per-doc")), "row_key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), "row_key",
    )
    return verdicts, hits


#: DuckDB SQL for the digest rows.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM i WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, ms WHERE len(w) >= m)),
h AS (SELECT dw.doc_id, dw.s, dw.m, iw.item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.m = iw.m),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS sha FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(sha, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
