"""Suffix-array dedup of bytes by external induced sorting, in shards.

A string of ``length`` bytes belongs to the smallest hash among its ``Q``-byte
grams (leftmost of equals), which depends on nothing outside it: equal strings have
the same anchor.  Consecutive starts with the same anchor place form a segment.
Segments whose anchor occurs once in the corpus cannot hold a repeat; a bitmap of
fixed size tells the others (a false bit only adds segments).  Segments that occur
twice or more are repeated as a whole and need no sorting.  Of the anchors with
several different segments, one of each is sent to the anchor's shard and clipped
to the bytes around the anchor that some other segment of it shares.  Where the
clipped strings of an anchor are one string they are repeats; others are sorted by external induced sorting, which carries the common-prefix
values, and starts next to a neighbour with at least ``length`` common bytes are
repeats.  Only segments of one anchor can share a string, so a shard is sorted in portions
of whole anchors of about ``portion`` bytes; the sorter keeps ``memory`` tuples and
symbols and puts the rest on disk.

No task gets more than ``most`` different segments of one anchor.  Where there are more,
the starts of each are cut into parts of ``FINER`` distances from start to anchor: equal
strings have the same distance.  A part takes the bytes that all strings of its distances
have in common for its anchor, and the parts go the way of segments.  Parts that
are still too many for one such anchor are cut into single strings, which a count settles.

Exact copies of whole texts are set aside first (all of their bytes are repeats);
one of each still counts as another place for near copies.

Defined results: null text is empty; texts shorter than ``length`` lose nothing;
a null doc_id is a document as any other; rows that repeat a text, with the same
doc_id or not, are copies of each other; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import induced
from tessera.llm import kernels as K
from tessera.llm import scratch as S
from tessera.llm.substring import in_bitmap, shared_bitmap

Q = 200
PORTION = 1 << 19
#: Different segments of one anchor that go to one task.
MOST = 256
#: Starts of a part, where an anchor has more than that; then of a part where the parts of one anchor are too many, too.
FINER = (16, 1)
#: Low bits of a packed gram that hold its place: texts are shorter than 2**32 bytes, and the cut does not depend on the piece.
PLACE_BITS = np.uint64(32)


def _sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, from block prefix and suffix minima."""
    n = len(x)
    blocks = np.full(-(-n // w) * w, ~np.uint64(0))
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first start, end start, anchor place, anchor hash) of a piece's segments."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, np.zeros(0, np.uint64)
    at = np.arange(len(data) - Q + 1)
    grams = K.span_hash(data, at, at + Q, seed=17)
    low = _sliding_minimum((grams >> PLACE_BITS << PLACE_BITS) | at.astype(np.uint64), length - Q + 1)
    place = (low & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(low)]
    ok = np.arange(len(low)) + length <= offsets[1:][text]
    new = np.ones(len(low), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new & ok)
    stop = np.flatnonzero(ok & np.append(new[1:] | ~ok[1:], True)) + 1
    return text[first], first, stop, place[first], grams[place[first]]


def _finer(batch: S.pa.RecordBatch, width: int, length: int):
    """Segments (key, row_key, first, off, bytes and more), each cut into parts of at most ``width`` starts by the distance from start to anchor."""
    raw = batch.column(4).to_pylist()
    data, size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw])
    anchor, first, off = (batch.column(i).to_numpy() for i in (0, 2, 3))
    base, starts = np.cumsum(size) - size, size - length + 1
    low = np.maximum(off - starts + 1, 0) // width
    count = off // width - low + 1
    own = np.repeat(np.arange(len(off)), count)
    near = (low[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)) * width  # least distance of the part
    far = near + width - 1
    begin, end = np.maximum(off[own] - far, 0), np.minimum(off[own] - near, starts[own] - 1) + length
    shared = K.span_hash(data, base[own] + off[own] - near, base[own] + off[own] - far + length, seed=29)
    key = K.mix64(shared ^ K.mix64(K.unsigned(anchor)[own] + (near * 1000 + width).astype(np.uint64)))
    s1, s2 = (K.span_hash(data, base[own] + begin, base[own] + end, seed=seed) for seed in (19, 23))
    yield S.batch(key=K.signed(key), s1=K.signed(s1), s2=K.signed(s2), row_key=batch.column(1).take(S.pa.array(own)), first=first[own] + begin, size=end - begin, off=off[own] - begin)


def _clip(group: list[tuple[bytes, int]], length: int) -> list[tuple[int, int]]:
    """For each (segment, anchor offset) of one anchor: the bytes that some other segment of it shares around the anchor."""

    def reach(strings: list[bytes]) -> list[int]:
        order = sorted(range(len(strings)), key=strings.__getitem__)
        out = [0] * len(strings)
        for a, b in zip(order, order[1:]):
            x, y = strings[a], strings[b]
            n = min(len(x), len(y))
            p, q = np.frombuffer(x, np.uint8, n), np.frombuffer(y, np.uint8, n)
            differ = np.flatnonzero(p != q)
            same = int(differ[0]) if len(differ) else n
            out[a], out[b] = max(out[a], same), max(out[b], same)
        return out

    right = reach([s[o:] for s, o in group])
    left = reach([s[:o][::-1] for s, o in group])
    return [(o - a, o + b) if a + b >= length else (0, 0) for (_, o), a, b in zip(group, left, right)]


def _sort_shard(batches, length: int, memory: int, portion: int = PORTION):
    """Rows (key, s1, s2, offset, bytes) sorted by key, in; (key, s1, s2, first, last) runs of repeated starts out."""

    def flush(strings: dict[bytes, list[tuple]]):
        pool = sorted(strings)
        if not pool:
            return
        sizes = np.array([len(p) for p in pool])
        at = np.concatenate([[0], np.cumsum(sizes + 1)])
        text = np.zeros(at[-1], np.int64)
        inside = np.ones(at[-1], bool)
        inside[at[1:] - 1] = False
        text[inside] = np.frombuffer(b"".join(pool), np.uint8).astype(np.int64) + len(pool)
        text[~inside] = np.arange(len(pool))  # each string has an end of its own
        sa, lcp = induced.suffixes(text, memory, len(pool))
        near = np.zeros(len(text), bool)
        big = np.flatnonzero(lcp >= length)
        near[sa[big]] = near[sa[big - 1]] = True
        for i, p in enumerate(pool):
            owners = strings[p]
            starts = np.arange(max(sizes[i] - length + 1, 0)) if len(owners) > 1 else np.flatnonzero(near[at[i] : at[i] + sizes[i]])
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) > 1) + 1
                for run in np.split(starts, cut):
                    for key, s1, s2, base in owners:
                        yield key, s1, s2, base + int(run[0]), base + int(run[-1])

    def close(key, rows, strings):
        """Clipped strings of one anchor to the pool; where all are the same string there is nothing to sort."""
        if len(rows) < 2:
            return 0
        clipped = [(r[3][a:b], (key, r[0], r[1], a)) for r, (a, b) in zip(rows, _clip([(r[3], r[2]) for r in rows], length)) if b > a]
        kinds = {c for c, _ in clipped}
        if len(kinds) == 1:
            equal.extend((*owner[:3], owner[3], owner[3] + len(c) - length) for c, owner in clipped if len(clipped) > 1)
            return 0
        for c, owner in clipped:
            strings.setdefault(c, []).append(owner)
        return sum(map(len, kinds))

    def table(rows):
        if rows:
            yield S.batch(**{c: np.array(v, np.int64) for c, v in zip(("key", "s1", "s2", "low", "high"), zip(*rows))})

    key, rows, strings, equal, held = None, [], {}, [], 0
    for batch in batches:
        keys, s1, s2, off = (batch.column(i).to_numpy() for i in range(4))
        raw = batch.column(4)
        for i in range(batch.num_rows):
            if keys[i] != key:
                held += close(key, rows, strings)
                key, rows = keys[i], []
                if held > portion:
                    yield from table(list(flush(strings)))
                    strings, held = {}, 0
            rows.append((s1[i], s2[i], int(off[i]), raw[i].as_py()))
        yield from table(equal)
        equal.clear()
    close(key, rows, strings)
    yield from table(equal)
    yield from table(list(flush(strings)))


def repeated_bytes(docs: DataFrame, length: int = 400, memory: int = 2_000_000, portion: int = PORTION, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): ``docs`` with ``copy`` and ``row_key``, and ranges of repeated starts by row_key."""
    scratch = S.Scratch(docs.sparkSession)
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    digest = F.md5(F.col("text").cast("binary"))
    copies = scratch.write(docs.groupBy(digest.alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1").select("digest", "first"), "copies")
    rows = docs.withColumn("digest", digest).join(S.small(copies.withColumn("copy", F.lit(True))), "digest", "left")
    rows = rows.withColumn("copy", F.coalesce("copy", F.lit(False))).withColumn("row_key", S.row_key(F.col("doc_id"), F.col("digest")))
    singles = rows.where(F.col("copy") == F.lit(False)).select("row_key", "text").unionByName(rows.where(F.col("copy") & F.col("doc_id").eqNullSafe(F.col("first"))).select("row_key", "text"))

    def anchors(batch):
        for _, _, data, offsets in K.pieces(batch.column(1)):
            yield S.batch(symbol=K.signed(segments(data, offsets, length)[4]))

    found = S.arrow_map(singles, anchors, "symbol long").groupBy("symbol").agg(F.count("*").alias("n"))
    bitmap = docs.sparkSession.sparkContext.broadcast(shared_bitmap(found.where("n > 1").select("symbol", F.explode(F.array(F.lit(0), F.lit(1))).alias("id")), scratch))

    def cut(batch):
        keys = batch.column(0)
        for row, _, data, offsets in K.pieces(batch.column(1)):
            text, first, stop, place, anchor = segments(data, offsets, length)
            hit = in_bitmap(bitmap.value, anchor)
            if not hit.any():
                continue
            text, first, stop, place, anchor = (x[hit] for x in (text, first, stop, place, anchor))
            end = stop + length - 1
            yield S.batch(key=K.signed(anchor), s1=K.signed(K.span_hash(data, first, end, seed=19)), s2=K.signed(K.span_hash(data, first, end, seed=23)), row_key=keys.take(S.pa.array(row + text)), first=(first - offsets[text]).astype(np.int64), size=(end - first).astype(np.int64), off=(place - first).astype(np.int64))

    schema = "key long, s1 long, s2 long, row_key binary, first long, size long, off long"
    parts, asked, ranges, used = scratch.write(S.arrow_map(singles, cut, schema), "segments"), None, [], []
    bitmap.destroy()

    def strings(some: DataFrame) -> DataFrame:
        x = asked.join(some, ["row_key", "place"]).dropDuplicates(["row_key", "place"]).select("row_key", "at", "raw", F.explode("x").alias("x"))
        return x.select("x.key", "row_key", "x.first", "x.off", F.expr("substring(raw, cast(x.first - at + 1 AS int), cast(x.size AS int))").alias("raw"), "x.s1", "x.s2", (F.col("x.first") + F.col("x.off")).alias("place"))

    for width in (*FINER, 0):
        kinds = scratch.write(parts.groupBy("key", "s1", "s2").agg(F.count("*").alias("n"), F.min(F.struct("row_key", "first", "size", "off")).alias("rep")), "kinds")
        mixed = kinds.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key", (F.col("k") > most if width else F.lit(False)).alias("hot"))
        place = F.lit(0) if asked is None else F.col("rep.first") + F.col("rep.off")
        wanted = kinds.join(mixed, "key").select("rep.row_key", place.cast("long").alias("place"), F.struct("key", "s1", "s2", "rep.off", "rep.first", "rep.size", "hot").alias("x"))
        wanted = scratch.write(wanted.groupBy("row_key", "place").agg(F.collect_list("x").alias("x")), "wanted")  # per text, at most its segments
        if asked is None:
            asked = scratch.write(singles.join(S.small(wanted.select("row_key")), "row_key", "left_semi").select("row_key", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("at"), F.col("text").cast("binary").alias("raw")), "asked")
            used.append(asked)
        cold, hot = (wanted.withColumn("x", F.expr(f"filter(x, y -> {which})")).where("size(x) > 0") for which in ("not y.hot", "y.hot"))
        shards = strings(cold).select("key", "s1", "s2", "off", "raw").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "s1", "s2")
        sorted_runs = scratch.write(shards.mapInArrow(lambda b: _sort_shard(b, length, memory, portion), "key long, s1 long, s2 long, low long, high long"), "runs")
        ranges.append(parts.join(kinds.where("n > 1").select("key", "s1", "s2"), ["key", "s1", "s2"], "left_semi").select("row_key", F.col("first").alias("low"), (F.col("first") + F.col("size") - length).alias("high")))
        ranges.append(parts.join(sorted_runs, ["key", "s1", "s2"]).select("row_key", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high")))
        used += [parts, kinds, wanted, sorted_runs]
        if hot.isEmpty():
            break
        whole = scratch.write(strings(S.small(hot)), "strings")
        parts = scratch.write(S.arrow_map(whole, lambda b, width=width: _finer(b, width, length), schema), "parts")
        if width == FINER[0]:  # finer parts lie in these
            asked = whole.select("row_key", "place", F.col("first").alias("at"), "raw")
        used.append(whole)
    spans = scratch.write(S.merge_ranges(reduce(DataFrame.unionByName, ranges), "row_key", "binary"), "spans")
    scratch.drop(*used)
    return rows, spans


def dedup_bytes(docs: DataFrame, length: int = 400, keep_bytes: bool = False, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``) for each row of ``docs``."""
    rows, spans = repeated_bytes(S.texts_of(docs), length, most=most)
    joined = rows.join(S.small(spans), "row_key", "left").select("doc_id", "text", "copy", "low", "high")

    def run(batch):
        copy, low, high = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
        out, row = [], 0
        for _, _, data, offsets in K.pieces(batch.column(1)):
            for a, b in zip(offsets[:-1], offsets[1:]):
                raw, n = data[a:b], int(b - a)
                gone = np.zeros(n, bool)
                if copy[row] and n >= length:
                    gone[:] = True
                elif low[row]:
                    delta = np.zeros(n + 1, np.int64)
                    np.add.at(delta, np.array(low[row]), 1)
                    np.add.at(delta, np.array(high[row]) + length, -1)
                    gone = np.cumsum(delta[:n]) > 0
                kept = raw[~gone].tobytes()
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0
                out.append((n, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
                row += 1
        n, removed, spans, sha, kept = zip(*out)
        more = {"kept": S.pa.array(kept, S.pa.binary())} if keep_bytes else {}
        yield S.batch(doc_id=batch.column(0), n_bytes=np.array(n, np.int64), n_removed=np.array(removed, np.int64), n_spans=np.array(spans, np.int64), kept_sha256=list(sha), **more)

    return S.arrow_map(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_bytes else ""))


def naive_dedup(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """Brute force for tests: (n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raw:
        gone = [False] * len(r)
        reach = 0
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                for j in range(max(i, reach), i + length):
                    gone[j] = True
                reach = i + length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out
