"""Substring dedup by recompression.

Each text's words are symbols.  A round names runs of a symbol, further rounds name
pairs of neighbours whose left symbol is on the left side of a two-colouring of all
symbols and whose right one is on the right side.  Spark chooses each round's
colouring for all documents: it counts, over every text, the pairs that each of a few
colourings would name, and the one that names most is used.  A name is a hash of what
it stands for, so it is the same in every document and task, and equal substrings get
equal symbols in their interior: an edge reaches at most 3 + 3 + 6 words inwards over
a run round and two pair rounds, so a repeat of 50 words keeps at least 26 words of
common symbols, from the last symbol that begins at its 13th word or before.  Of the
14 words from there the smallest symbol is the window's anchor; the sequence of
symbols that begin within 12 words of it names the window, and so does every run of
four words or more.  All windows of equal words have equal names or runs.

Names that occur in two documents or more go into a bitmap sized by their count, sent
to the tasks; the windows whose name is in it are verified: 128 bits of their words
must be equal.  A window's smallest doc_id is found by a grouped minimum (combined
before the shuffle), and the windows that start in a smaller document are joined back.
A false bit only adds windows to that exact check.  Exact copies of whole texts are
set aside first.

Defined results: null text has no words; documents of fewer than ``window`` words
lose nothing; rows with the same doc_id are not smaller than each other; a null
doc_id neither loses words nor gives them to others; repeated rows each get a
result row; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm import scratch as S

LONG_RUN = 4
MARGIN, CHOICE, STRETCH = 12, 14, 12
#: Colourings tried for each of the pair rounds.
COLOURINGS = 4
ROUNDS = 2
#: Bits of the bitmap for each shared name, and at most.
BITS_PER_NAME, MOST_BITS = 16, 29


def _right(symbol: np.ndarray, colouring: int) -> np.ndarray:
    return K.mix64(symbol + np.uint64(colouring)) >> np.uint64(63) == 1


def choose_colourings(docs: DataFrame) -> tuple[int, ...]:
    """For each pair round the colouring that names most pairs, counted over all texts of ``docs`` (doc_id, text)."""
    chosen: tuple[int, ...] = ()
    for level in range(1, ROUNDS + 1):
        tried = [level + ROUNDS * c for c in range(COLOURINGS)]

        def pairs(batch, done=chosen, tried=tried):
            total = np.zeros(len(tried), np.int64)
            for _, _, data, offsets in K.pieces(batch.column(1)):
                words = K.Words(data, offsets, seed=3)
                symbol, begin, _, _ = compress(words, done)
                doc = np.searchsorted(words.first, begin, "right")
                same = doc[1:] == doc[:-1]
                for i, c in enumerate(tried):
                    right = _right(symbol, c)
                    total[i] += int((~right[:-1] & right[1:] & same).sum())
            yield S.batch(colouring=np.array(tried, np.int64), n=total)

        found = S.arrow_map(docs, pairs, "colouring long, n long").groupBy("colouring").agg(F.sum("n").alias("n"))
        best = found.orderBy(F.desc("n"), "colouring").first()
        chosen += (int(best[0]) if best else tried[0],)
    return chosen


def compress(words: K.Words, colourings: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, first word, end word) after the rounds, and the long runs of one word likewise."""
    h, doc = words.hash, words.doc()
    if not len(h):
        none = np.zeros(0, np.int64)
        return h, none, none, (h, none, none)
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(h)))
    symbol, doc = h[begin], doc[begin]
    long = length >= LONG_RUN
    runs = K.mix64(symbol[long] ^ np.uint64(0x2545F4914F6CDD1D)), begin[long], begin[long] + length[long]
    symbol = np.where(length > 1, K.mix64(symbol * np.uint64(0x9FB21C651E98DF25) + np.minimum(length, LONG_RUN).astype(np.uint64)), symbol)
    end = begin + length
    for level, colouring in enumerate(colourings, 1):
        right = _right(symbol, colouring)
        join = np.zeros(len(symbol), bool)
        join[:-1] = ~right[:-1] & right[1:] & (doc[:-1] == doc[1:])
        at = np.flatnonzero(join)
        named = symbol.copy()
        named[at] = K.mix64(symbol[at] * np.uint64(0xD1342543DE82EF95) + symbol[at + 1] + np.uint64(level))
        end = end.copy()
        end[at] = end[at + 1]
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        symbol, begin, end, doc = named[keep], begin[keep], end[keep], doc[keep]
    return symbol, begin, end, runs


def _sequence_names(symbol: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each symbol the name of the sequence of those that begin within ``STRETCH`` words of it, in its text."""
    n = len(symbol)
    power, inverse = K.power_tables(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix64(symbol) * power[:n])])
    end = np.searchsorted(begin, np.minimum(begin + STRETCH, stop[begin]))
    return K.mix64((sums[end] - sums[:n]) * inverse[:n] + (end - np.arange(n)).astype(np.uint64))


def window_names(words: K.Words, window: int, colourings: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, name of each) of the windows inside texts, and (name, first, last start) of the windows that hold a long run."""
    n = len(words.hash)
    doc = words.doc()
    starts = np.flatnonzero(K.same_text(words.first, window, doc))
    symbol, begin, end, (run, r_begin, r_end) = compress(words, colourings)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), (run[:0], r_begin[:0], r_begin[:0])
    stop = words.first[1:][doc]  # of each word, where its text ends
    limit = np.minimum(begin + CHOICE, stop[begin])
    count = np.maximum(np.searchsorted(end, limit, "right") - np.arange(len(symbol)), 1)
    best = [np.arange(len(symbol))]
    while 2 << (len(best) - 1) <= count.max():
        step, a = 1 << (len(best) - 1), best[-1]
        b = a[np.minimum(np.arange(len(a)) + step, len(a) - 1)]
        best.append(np.where(symbol[a] <= symbol[b], a, b))
    level = np.floor(np.log2(count)).astype(int)
    table = np.stack(best)
    i = np.arange(len(symbol))
    a, b = table[level, i], table[level, i + count - (1 << level)]
    chosen = np.where(symbol[a] <= symbol[b], a, b)
    names = _sequence_names(symbol, begin, stop)[chosen][np.searchsorted(begin, starts + MARGIN, "right") - 1]
    where = np.searchsorted(words.first, r_begin, "right") - 1
    low, high = np.maximum(r_begin + LONG_RUN - window, words.first[where]), np.minimum(r_end - LONG_RUN, words.first[where + 1] - window)
    ok = low <= high
    return starts, names, (run[ok], low[ok], high[ok])


def shared_bitmap(pairs: DataFrame, scratch: S.Scratch) -> np.ndarray:
    """Bitmap of the symbols that occur under two ids or more, of a power of two of bits for their count; ``pairs`` has symbol and id."""
    shared = pairs.groupBy("symbol").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("symbol")
    shared = scratch.write(shared, "shared-names")
    bits = int(min(max((BITS_PER_NAME * shared.count()).bit_length(), 16), MOST_BITS))
    slots = shared.selectExpr(f"shiftrightunsigned(symbol, {64 - bits}) AS slot").selectExpr("shiftright(slot, 6) AS word", "shiftleft(1L, cast(slot % 64 AS int)) AS bit")
    words = slots.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2**(bits - 6) rows
    scratch.drop(shared)
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[words.column("word").to_numpy()] = K.unsigned(words.column("bits").to_numpy())
    return bitmap


def in_bitmap(bitmap: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    slot = symbol >> np.uint64(65 - (64 * len(bitmap)).bit_length())
    return bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1) == 1


def repeated_words(docs: DataFrame, window: int = 50) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): ``docs`` (doc_id, text) with ``copy`` (an earlier text is the same) and the ranges (low, high) of repeated window starts by doc_id."""
    scratch = S.Scratch(docs.sparkSession)
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    copies = docs.where("doc_id is not null").groupBy(digest.alias("digest")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    copies = scratch.write(copies, "copies")
    rows = docs.withColumn("digest", digest).join(S.small(copies), "digest", "left").select(*docs.columns, F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy"))
    singles = rows.where("not copy and doc_id is not null").select("doc_id", "text")
    colourings = choose_colourings(singles)

    def symbols(batch):
        ids = batch.column(0).to_numpy()
        for first, _, data, offsets in K.pieces(batch.column(1)):
            words = K.Words(data, offsets, seed=3)
            starts, names, (run, low, _) = window_names(words, window, colourings)
            at = np.concatenate([starts, low])
            own = np.searchsorted(words.first, at, "right") - 1
            d, name, _ = K.unique_in_text(own, np.concatenate([names, run]))
            yield S.batch(symbol=K.signed(name), id=ids[first + d])

    bitmap = docs.sparkSession.sparkContext.broadcast(shared_bitmap(S.arrow_map(singles, symbols, "symbol long, id long"), scratch))

    def windows(batch):
        ids = batch.column(0).to_numpy()
        for first, _, data, offsets in K.pieces(batch.column(1)):
            words = K.Words(data, offsets, seed=3)
            starts, names, (run, low, high) = window_names(words, window, colourings)
            delta = np.zeros(len(words.hash) + 1, np.int64)
            hit = in_bitmap(bitmap.value, run)
            np.add.at(delta, low[hit], 1)
            np.add.at(delta, high[hit] + 1, -1)
            at = starts[in_bitmap(bitmap.value, names) | (np.cumsum(delta)[starts] > 0)]
            if not len(at):
                continue
            where = np.searchsorted(words.first, at, "right") - 1
            yield S.batch(hash=K.signed(K.grams(words.hash, window)[at]), check=K.signed(K.grams(K.mix64(words.hash + np.uint64(1)), window)[at]), doc_id=ids[first + where], start=(at - words.first[where]).astype(np.int32))

    found = S.arrow_map(singles, windows, "hash long, check long, doc_id long, start int")
    earliest = found.groupBy("hash", "check").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("hash", "check", "low")
    earliest = scratch.write(earliest, "earliest")  # written: the join below can split a window of many documents
    later = found.join(earliest, ["hash", "check"]).where("doc_id > low").select("doc_id", "start")
    spans = scratch.write(S.merge_ranges(later.distinct().select("doc_id", F.col("start").cast("long").alias("low"), F.col("start").cast("long").alias("high")), "doc_id"), "spans")
    bitmap.destroy()
    scratch.drop(earliest)
    return rows, spans


def dedup_substrings(docs: DataFrame, window: int = 50, keep_rows: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of ``docs``; with ``keep_rows`` also ``kept`` (the remaining words) and ``row`` (all its columns)."""
    more = [S.whole_row(docs).alias("row")] if keep_rows else []
    rows, spans = repeated_words(docs.select("doc_id", "text", *more), window)
    joined = rows.join(S.small(spans), "doc_id", "left").select("doc_id", "text", "copy", "low", "high", *["row"] * keep_rows)

    def run(batch):
        copy = batch.column(2).to_numpy(zero_copy_only=False)
        low, high = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        n_words, n_removed, sha, kept = [], [], [], []
        row = 0
        for _, _, data, offsets in K.pieces(batch.column(1)):
            for a, b in zip(offsets[:-1], offsets[1:]):
                words = data[a:b].tobytes().split()
                n = len(words)
                if copy[row] and n >= window:
                    words = []
                elif low[row]:
                    gone = np.zeros(n, bool)
                    for i, j in zip(low[row], high[row]):
                        gone[i : j + window] = True
                    words = [w for w, g in zip(words, gone) if not g]
                text = b" ".join(words)
                n_words.append(n)
                n_removed.append(n - len(words))
                sha.append(hashlib.sha256(text).hexdigest())
                kept.append(text)
                row += 1
        out = {"doc_id": batch.column(0), "n_words": np.array(n_words, np.int64), "n_removed": np.array(n_removed, np.int64), "kept_sha256": sha}
        if keep_rows:
            out["kept"], out["row"] = S.pa.array([k.decode("utf-8", "replace") for k in kept], S.pa.string()), batch.column(5)
        yield S.batch(**out)

    return S.arrow_map(joined, run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (f", kept string, row {joined.schema['row'].dataType.simpleString()}" if keep_rows else ""))


#: DuckDB SQL for the digest rows.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS MATERIALIZED (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
m AS (SELECT g, min(doc_id) AS low FROM p GROUP BY g),
r AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM p JOIN m USING (g) WHERE doc_id > low),
x AS (SELECT doc_id, count(*) AS n, list(i) AS gone FROM r GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, CASE WHEN gone IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i))) END AS kept FROM d LEFT JOIN x USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
