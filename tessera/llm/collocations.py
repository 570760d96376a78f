"""Phrase collocations by level-wise counting with hashed buckets.

Texts are read once for each phrase length.  While phrases of k words are counted exactly,
every phrase of k + 1 words adds one to a bucket of a hash table.  Bucket counts of all
tasks are summed by bucket range (a count stops at the threshold, which is all that
matters), and a bitmap of the buckets that reach the threshold is sent to the tasks.  The
next pass counts a phrase only if its bucket's bit is set and both phrases that it
consists of, less its last or first word, were frequent (a second bitmap, by hash).  Both
tests let a few more phrases through, never fewer, so exact counts by the phrases
themselves decide; the size of the bitmaps (``2 ** bucket_bits`` bits each, whatever the
corpus) changes the work, not the result.

Defined results: null text is empty; a null language is ``und``, one class with a literal
``und``; repeated rows count each; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm import scratch as S

#: Buckets of a hash table, as a power of two: a bitmap of 8 MB.
BUCKET_BITS = 26
#: Buckets of one range: offsets in it take 16 bits.
RANGE_BITS = 16
#: Phrases and buckets that a task gathers before it sends them.
PENDING = 400_000
PENDING_BUCKETS = 2_000_000

BREAKS = np.zeros(256, bool)
BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
WORD = ~BREAKS
WORD[list(b" \t")] = False
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class Bitmap:
    """Bits by the leading ``bits`` bits of a 64-bit hash."""

    def __init__(self, bits: int, packed: np.ndarray | None = None):
        self.bits = bits
        self.packed = np.zeros(1 << max(0, bits - 3), np.uint8) if packed is None else packed

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _bucket_rows(buckets: np.ndarray, weights: int | None, enough: int, bits: int):
    """Rows (range, offsets, counts) of the buckets met; counts stop at ``enough``; ``weights`` stands for every count."""
    at, n = np.unique(buckets, return_counts=True)
    n = np.minimum(n, enough).astype(np.uint8) if weights is None else np.full(len(at), weights, np.uint8)
    width = min(RANGE_BITS, bits)
    ranges = (at >> np.uint64(width)).astype(np.int32)
    cut = np.flatnonzero(np.diff(ranges, prepend=-1))
    offsets = (at & np.uint64((1 << width) - 1)).astype(np.uint16)
    for a, b in zip(cut, [*cut[1:], len(at)]):
        yield int(ranges[a]), offsets[a:b].tobytes(), n[a:b].tobytes()


def bitmap(rows: DataFrame, bits: int, enough: int) -> Bitmap:
    """Bits of the buckets whose counts, over all rows (range, at, counts), reach ``enough``: summed in tasks, one range each."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        width = 1 << min(RANGE_BITS, bits)
        for rows in batches:
            for r, at, n in zip(*(c.to_pylist() for c in rows.columns)):
                counts = held.setdefault(r, np.zeros(width, np.uint8))
                at = np.frombuffer(at, np.uint16)
                counts[at] = np.minimum(counts[at].astype(np.uint16) + np.frombuffer(n, np.uint8), enough)
        if held:
            yield S.batch(range=pa.array(list(held), pa.int32()), packed=pa.array([np.packbits(c >= enough, bitorder="little").tobytes() for c in held.values()], pa.binary()))
        S.release()

    S.ship(rows.sparkSession)
    out = Bitmap(bits)
    step = max(1, (1 << min(RANGE_BITS, bits)) // 8)
    for r in rows.repartition("range").mapInArrow(run, "range int, packed binary").toLocalIterator():
        out.packed[r["range"] * step : (r["range"] + 1) * step] = np.frombuffer(r["packed"], np.uint8)
    return out


_PASS = "lang string, phrase string, hash long, n long, range int, at binary, counts binary"


def _counted(docs: DataFrame, k: int, longest: int, tests, enough: int, bits: int) -> DataFrame:
    """One pass: exact counts of phrases of k words that pass ``tests`` (frequent shorter phrases, buckets), and bucket counts of those of k + 1."""
    shared = docs.sparkSession.sparkContext.broadcast(tests) if tests else None

    def run(batches):
        frequent, likely = shared.value if shared else (None, None)
        hashes, counts, spelt, langs, buckets = [], [], [], [], []

        def send():
            if hashes:
                h, first, back = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
                n = np.bincount(back, np.concatenate(counts), len(h)).astype(np.int64)
                words, lang = np.concatenate(spelt)[first], np.concatenate(langs)[first]
                for x in (hashes, counts, spelt, langs):
                    x.clear()
                for at in range(0, len(h), 50_000):
                    part = slice(at, at + 50_000)
                    size = len(h[part])
                    none = [pa.nulls(size, t) for t in (pa.int32(), pa.binary(), pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array(lang[part].tolist(), pa.string()), pa.array(words[part].tolist(), pa.string()), pa.array(K.signed(h[part])), pa.array(n[part]), *none], names=names)

        def send_buckets():
            if buckets:
                rows = list(_bucket_rows(np.concatenate(buckets), None, enough, bits))
                buckets.clear()
                none = [pa.nulls(len(rows), t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64())]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*none, *columns], names=names)

        for rows in batches:
            lang = rows.column(1).fill_null("und").dictionary_encode()
            named = np.array(lang.dictionary.to_pylist(), object)
            salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in named], np.uint64)
            codes = lang.indices.to_numpy()
            for row, _, data, offsets in K.pieces(rows.column(0)):
                words = K.Words(data, offsets, WORD, lower=True)
                if not len(words.start):
                    continue
                doc = words.doc()
                code = codes[row + doc]
                h = K.mix64(words.hash ^ salts[code])
                piece = np.cumsum(BREAKS[data], dtype=np.int64)[words.start]
                next_too = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
                joined = {1: np.ones(len(h), bool)}  # whether the j words from each word on are in one piece
                for j in range(2, k + 2):
                    joined[j] = joined[j - 1][: max(0, len(h) - j + 1)] & next_too[j - 2 :][: max(0, len(h) - j + 1)]
                gram = {j: h if j == 1 else K.grams(h, j) for j in range(max(1, k - 1), k + 2)}
                ok = joined[k]
                if k > 1 and len(ok):
                    ok = ok.copy()
                    at = np.flatnonzero(ok)
                    at = at[likely.has(gram[k][at])]
                    at = at[frequent.has(gram[k - 1][at])]
                    at = at[frequent.has(gram[k - 1][at + 1])]
                    ok[:] = False
                    ok[at] = True
                at = np.flatnonzero(ok)
                if len(at):
                    u, first, n = np.unique(gram[k][at], return_index=True, return_counts=True)
                    raw, first = data.tobytes().translate(_LOWER), at[first]
                    if k == 1:
                        texts = [raw[a:b].decode() for a, b in zip(words.start[first].tolist(), words.end[first].tolist())]
                    else:
                        texts = [" ".join(raw[words.start[i + j] : words.end[i + j]].decode() for j in range(k)) for i in first.tolist()]
                    box = np.empty(len(texts), object)
                    box[:] = texts
                    hashes.append(u)
                    counts.append(n)
                    spelt.append(box)
                    langs.append(named[code[first]])
                if k < longest and len(h) > k:
                    both = joined[k + 1] & ok[:-1] & ok[1:]
                    buckets.append(gram[k + 1][both] >> np.uint64(64 - bits))
                if sum(map(len, hashes)) > PENDING:
                    yield from send()
                if sum(map(len, buckets)) > PENDING_BUCKETS:
                    yield from send_buckets()
        yield from send()
        yield from send_buckets()
        S.release()

    names = [x.split()[0] for x in _PASS.split(", ")]
    S.ship(docs.sparkSession)
    return docs.select("text", "lang").mapInArrow(run, _PASS)


def _hash_rows(frequent: DataFrame, bits: int) -> DataFrame:
    """Rows (range, at, counts) that set the bits of (hash) rows."""

    def run(rows):
        out = list(_bucket_rows(K.unsigned(rows.column(0).to_numpy()) >> np.uint64(64 - bits), 1, 1, bits))
        yield S.batch(range=pa.array([r for r, _, _ in out], pa.int32()), at=pa.array([a for _, a, _ in out], pa.binary()), counts=pa.array([c for _, _, c in out], pa.binary()))

    return S.arrow_map(frequent.select("hash"), run, "range int, at binary, counts binary")


def phrase_counts(docs: DataFrame, longest: int, least: int, bucket_bits: int = BUCKET_BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, f) of all phrases of 1 to ``longest`` words with f >= ``least``, (lang, n) words in all)."""
    if not (longest >= 1 and least >= 1 and 3 <= bucket_bits <= 32):
        raise ValueError("longest and least must be positive, bucket_bits 3 to 32")
    scratch = S.Scratch(docs.sparkSession)
    enough = min(least, 255)
    tests, levels, totals = None, [], None
    for k in range(1, longest + 1):
        counted = scratch.write(_counted(docs, k, longest, tests, enough, bucket_bits), f"pass{k}")
        exact = counted.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"), F.min("hash").alias("hash"))
        if k == 1:
            totals = scratch.write(counted.where("phrase is not null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        level = scratch.write(exact.where(F.col("f") >= least), f"level{k}")
        levels.append(level.select("lang", "phrase", F.lit(k).alias("k"), "f"))
        if k < longest:
            likely = bitmap(counted.where("range is not null").select("range", "at", "counts"), bucket_bits, enough)
            tests = bitmap(_hash_rows(level, bucket_bits), bucket_bits, 1), likely
        scratch.drop(counted)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, totals


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, contained_percent: int = 50, top: int = 2000, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """Per language the ``top`` phrases of 2 to ``longest`` words by the score of their weakest cut: lang, rank, phrase, a, l, r, n, score.

    A cut after the first words gives the score floor(10^6 * a * a / (l * r)), exact in decimals;
    of equal cuts the first counts.  A phrase goes if a longer candidate holds its words in
    a row and occurs at least ``contained_percent`` of a hundred times as often.
    """
    scratch = S.Scratch(docs.sparkSession)
    counts, totals = phrase_counts(docs, longest, least, bucket_bits)
    counts = scratch.write(counts, "counts")
    parts = counts.select("lang", "phrase", "f")
    candidates = counts.where("k > 1").withColumnRenamed("f", "a")
    word = F.split("phrase", " ")
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumn("left", F.array_join(F.slice(word, F.lit(1), F.col("cut")), " ")).withColumn("right", F.array_join(F.slice(word, F.col("cut") + 1, F.col("k") - F.col("cut")), " "))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)) * cast(1000000 as decimal(7, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))"))
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("weak"))
    longer = candidates.where("k > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    longer = longer.select("lang", F.array_join(F.slice(word, F.col("at"), F.col("size")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < contained_percent * F.col("a"), F.lit(True)))
    kept = kept.select("lang", "phrase", "a", "weak.l", "weak.r", "weak.score")
    # the first of each of many parts of a language, then the first of those: no task ranks a whole language
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part", "rank")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
with pieces as (
  select doc_id, coalesce(lang, 'und') lang, i, unnest(range(1, len(p) + 1)) as j, p
  from (select row_number() over () as doc_id, lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as p, 0 as i from documents)
),
words as (select lang, regexp_extract_all(p[j], '[^\x20\x09]+') as w from pieces),
grams as (
  select lang, k, array_to_string(w[s : s + k - 1], ' ') as phrase
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as s from words, (values (1), (2), (3)) t(k) where len(w) >= k)
),
counts as (select lang, k, phrase, count(*) as f from grams group by all having count(*) >= 10),
totals as (select lang, count(*) as n from grams where k = 1 group by lang),
cuts as (
  select c.lang, c.phrase, c.k, c.f as a, t.cut, array_to_string(string_split(c.phrase, ' ')[1 : t.cut], ' ') as x, array_to_string(string_split(c.phrase, ' ')[t.cut + 1 : c.k], ' ') as y
  from counts c, (values (1), (2)) t(cut) where c.k > 1 and t.cut < c.k
),
scored as (
  select c.lang, c.phrase, c.a, l.f as l, r.f as r, c.cut, (1000000::hugeint * c.a * c.a) // (l.f::hugeint * r.f) as score
  from cuts c join counts l on l.lang = c.lang and l.phrase = c.x join counts r on r.lang = c.lang and r.phrase = c.y
),
weakest as (select * from (select *, row_number() over (partition by lang, phrase order by score, cut) as o from scored) where o = 1),
longer as (
  select lang, phrase, max(f) as f from (
    select lang, array_to_string(string_split(phrase, ' ')[t.o : t.o + 1], ' ') as phrase, f from counts, (values (1), (2)) t(o) where k = 3
  ) group by all
)
select w.lang, cast(rank as bigint) as rank, w.phrase, a, l, r, n, cast(score as bigint) as score
from (
  select w.*, row_number() over (partition by w.lang order by score desc, a desc, w.phrase) as rank
  from weakest w left join longer g on g.lang = w.lang and g.phrase = w.phrase where g.f is null or 100 * g.f < 50 * a
) w join totals t on t.lang = w.lang where rank <= 2000
"""
