"""N-gram Jaccard self-join with skips over set relations.

A document's set holds the 64-bit hashes of its distinct word shingles; equal sets
(128-bit digest) collapse to one node.  In the global order (frequent shingles last,
then by hash) only a set's prefix of n - ceil(t n) + 1 shingles is indexed, and of
those only the ones that a second set shares.

Answers derived from a similar set: each index list has a pivot, the set that shares
most of its prefix, and the sets of all lists of a pivot are its cell.  Index level:
an entry whose prefix position cannot leave the required overlap with the pivot's is
skipped.  Sets linked with a pivot take over its answer, the component, so no two sets
of one component are compared again.  What is left are cells with several components,
and any two sets that share an indexed shingle are in one cell.  In these, sets are
ordered by size, and runs whose size cannot reach the overlap are skipped as blocks;
the first set of each component computes its distances to the cell once, and the
component's other sets derive theirs from them: by the triangle inequality only sets
inside the ring of its distance and the allowed distance are looked at.  Distances are
Hamming distances of parity bitmaps, which never exceed the number of shingles that
two sets do not share.  Two similar sets also share at least their required overlap
less the larger rest behind a prefix in their prefixes: sets that know fewer shared
shingles are no pair.  Pairs that pass are few, and each is then checked exactly on
both texts.

A cell of more than ``block`` sets is dealt to several tasks: sets of its largest
component by hash, the others copied to each.  This changes where a pair is looked at,
not which pairs are.

Frequent shingles are found by mergeable counters over all documents (Misra-Gries);
any set of them gives the same links.  At most ``FREQUENT`` times the mean set size
shingles are that frequent, whatever the corpus size.  Defined results: null text and
text without words have the empty set, are linked with nothing and are their own
component; a text of fewer than k words is one shingle; a null doc_id takes part in
no component (component_id null); repeated rows each get a result row, and rows that
share a doc_id but not a set are sets of their own; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm import scratch as S
from tessera.llm.components import connected_components

#: A shingle in more than one of so many documents counts as frequent.
FREQUENT = 16_000
COUNTERS = 400_000
#: Sets of one cell that one task takes at most.
BLOCK = 4096
#: Words of a parity bitmap: 16 bits a shingle, at most ``WIDEST``; pairs are first looked at in ``NARROW`` folded words.
WIDEST, NARROW = 256, 8


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each text's distinct shingles, sorted by text and hash."""
    words = K.Words(data, offsets, lower=True, seed=9)
    doc = words.doc()
    full = K.same_text(words.first, k, doc)
    n = np.diff(words.first)
    parts_d, parts_h = [doc[: len(full)][full]], [K.grams(words.hash, k)[full]]
    for m in range(1, k):  # whole sequences of m words
        own = np.flatnonzero(n == m)
        if len(own):
            h = np.zeros(len(own), np.uint64)
            for j in range(m):
                h = (h + words.hash[words.first[own] + j]) * np.uint64(0xD6E8FEB86659FD93)
            parts_d.append(own)
            parts_h.append(K.mix64(h + np.uint64(m)))
    d, h, _ = K.unique_in_text(np.concatenate(parts_d), np.concatenate(parts_h))
    return d, h


def set_digests(d: np.ndarray, h: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and 128-bit digest of each text's set."""
    one, two = np.zeros(texts, np.uint64), np.zeros(texts, np.uint64)
    np.add.at(one, d, K.mix64(h))
    np.add.at(two, d, K.mix64(h ^ np.uint64(0x5851F42D4C957F2D)))
    return np.bincount(d, minlength=texts).astype(np.int64), K.signed(one), K.signed(two)


def parity_bitmaps(d: np.ndarray, h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, words per text): each text's parities of hashed shingles in a power of two of at least 16 n bits, or of ``WIDEST`` words."""
    wide = np.minimum(WIDEST, 1 << np.ceil(np.log2(np.maximum(size, 1) / 4)).clip(0).astype(np.int64))
    wide[size == 0] = 0
    begin = np.concatenate([[0], np.cumsum(wide)])
    out = np.zeros(begin[-1], np.uint64)
    slot = K.mix64(h ^ np.uint64(0x7F4A7C159E3779B9))
    low = slot & (wide[d].astype(np.uint64) * np.uint64(64) - np.uint64(1))
    np.bitwise_xor.at(out, begin[d] + (low >> np.uint64(6)).astype(np.int64), np.uint64(1) << (low & np.uint64(63)))
    return out, wide


def frequent_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of shingles in about more than 1/FREQUENT of the documents: at most FREQUENT times the mean set size."""

    def run(batches):
        key, count, n = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for rows in batches:
            n += rows.num_rows
            for _, _, data, offsets in K.pieces(rows.column(0)):
                _, h = shingle_sets(data, offsets, k)
                new, c = np.unique(h, return_counts=True)
                both, which = np.unique(np.concatenate([key, new]), return_inverse=True)
                count = np.bincount(which, np.concatenate([count, c]), minlength=len(both)).astype(np.int64)
                key = both
                if len(key) > COUNTERS:
                    count = count - np.partition(count, -COUNTERS)[-COUNTERS]
                    key, count = key[count > 0], count[count > 0]
        often = count >= max(2, n // (2 * FREQUENT))
        for at in range(0, int(often.sum()), 100_000):
            yield S.batch(h=K.signed(key[often][at : at + 100_000]), n=count[often][at : at + 100_000])
        S.release()

    S.ship(docs.sparkSession)
    total = docs.count()
    found = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= max(12, total // FREQUENT))
    return np.sort(K.unsigned(found.select("h").toArrow().column("h").to_numpy()))


def indexed_sets(docs: DataFrame, k: int, percent: int, often) -> DataFrame:
    """(doc_id, row_key, n, h1, h2, prefix) of (doc_id, text, row_key): set size, digest, and prefix in the global order; ``often`` is a broadcast."""

    def run(rows):
        hot = often.value
        for first, end, data, offsets in K.pieces(rows.column(1)):
            d, h = shingle_sets(data, offsets, k)
            size, one, two = set_digests(d, h, end - first)
            at = np.minimum(np.searchsorted(hot, h), max(len(hot) - 1, 0))
            late = (hot[at] == h) if len(hot) else np.zeros(len(h), bool)
            order = np.lexsort((h, late, d))
            place = np.arange(len(h)) - np.concatenate([[0], np.cumsum(size)])[d]
            keep = place < (size - (percent * size + 99) // 100 + 1)[d]
            yield S.batch(doc_id=rows.column(0).slice(first, end - first), row_key=rows.column(2).slice(first, end - first), n=size, h1=one, h2=two, prefix=K.list_array(K.signed(h[order][keep]), np.bincount(d[keep], minlength=end - first)))

    return S.arrow_map(docs, run, "doc_id long, row_key binary, n long, h1 long, h2 long, prefix array<long>")


def bitmaps(texts: DataFrame, k: int) -> DataFrame:
    """(node, bits) of (node, n, h1, h2, text): the parity bitmap of each node's set."""

    def run(rows):
        node, n, h1, h2 = (rows.column(i).to_numpy() for i in range(4))
        for first, end, data, offsets in K.pieces(rows.column(4)):
            d, h = shingle_sets(data, offsets, k)
            size, one, two = set_digests(d, h, end - first)
            own = (size == n[first:end]) & (one == h1[first:end]) & (two == h2[first:end])  # another text of the same doc_id is not the node's
            bits, wide = parity_bitmaps(d, h, size)
            yield S.batch(node=node[first:end][own], bits=K.list_array(K.signed(bits), wide).filter(S.pa.array(own)))

    return S.arrow_map(texts, run, "node long, bits array<long>")


def whole_lists(batches) -> Iterator:
    """Record batches cut so that each run of equal first columns (sorted) lies in one table."""
    held, last = [], None
    for rows in batches:
        if not rows.num_rows:
            continue
        key = rows.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if held and cut == 0 and last == key[-1]:
            held.append(rows)
            continue
        done = [*held, rows.slice(0, cut)] if cut else held
        if done:
            yield S.pa.Table.from_batches(done).combine_chunks()
        held, last = [rows.slice(cut)], key[-1]
    if held:
        yield S.pa.Table.from_batches(held).combine_chunks()


def cell_pairs(n: np.ndarray, comp: np.ndarray, known: np.ndarray, begin: np.ndarray, wide: np.ndarray, bits: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of one cell, ordered by size, that lie in different components and may be similar."""
    out = []

    def far(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
        return np.bitwise_count(rows ^ one).sum(1, dtype=np.int64)

    for w in np.unique(wide):  # a similar set is at most 5/4 as large: its bitmap has as many words or twice as many
        own = wide == w
        at = np.flatnonzero(own | (wide == 2 * w))
        full = bits[begin[at][:, None] + np.arange(w)]
        double = np.flatnonzero(~own[at])
        full[double] ^= bits[begin[at][double][:, None] + w + np.arange(w)]
        narrow = full if w <= NARROW else np.bitwise_xor.reduce(full.reshape(len(at), -1, NARROW), axis=1)
        nn, cc, kk = n[at], comp[at], known[at]
        order = np.flatnonzero(own[at])
        order = order[np.argsort(cc[order], kind="stable")]
        leader, distance = None, None
        for i in order:
            stop = int(np.searchsorted(nn, nn[i] * 100 // percent, "right"))
            if stop <= i + 1:
                continue
            if leader is None or cc[leader] != cc[i]:  # the component's answer in this cell
                leader, distance = i, far(narrow, narrow[i])
            j = np.arange(i + 1, stop)
            most = (100 - percent) * (nn[j] + nn[i]) // (100 + percent)
            j = j[(cc[j] != cc[i]) & (np.abs(distance[j] - distance[i]) <= most)]
            j = j[np.minimum(kk[j], kk[i]) >= needed(nn[j], nn[i], percent)]
            for table in (narrow, full):
                if len(j):
                    j = j[far(table[j], table[i]) <= (100 - percent) * (nn[j] + nn[i]) // (100 + percent)]
            if len(j):
                out.append((np.full(len(j), at[i]), at[j]))
    return out


def needed(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Shared prefix shingles that two similar sets have at least: behind the prefix that ends first lie at most ceil(t n) - 1 more."""
    overlap = -(-percent * (na + nb) // (100 + percent))
    return np.maximum(overlap - (-(-percent * np.maximum(na, nb) // 100)) + 1, 1)


def close_pairs(percent: int):
    """Kernel: rows (cell, n, node, comp, known, bits) sorted by cell and n in; pairs (a, b) out."""

    def run(batches):
        for rows in whole_lists(batches):
            cell, n, node, comp, known = (rows.column(i).to_numpy() for i in range(5))
            lists = rows.column(5).combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, S.pa.ChunkedArray) else lists
            offsets, bits = lists.offsets.to_numpy().astype(np.int64), K.unsigned(lists.values.to_numpy())
            start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            stop = np.append(start[1:], len(cell))
            found = []
            for s, e in zip(start, stop):
                if e - s > 1 and (comp[s:e] != comp[s]).any():
                    found += [(i + s, j + s) for i, j in cell_pairs(n[s:e], comp[s:e], known[s:e], offsets[s:e], np.diff(offsets[s : e + 1]), bits, percent)]
            if found:
                i, j = (np.concatenate(x) for x in zip(*found))
                pair = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]), axis=1)
                for at in range(0, pair.shape[1], 100_000):
                    yield S.batch(a=pair[0, at : at + 100_000], b=pair[1, at : at + 100_000])

    return run


def texts_of_nodes(nodes: DataFrame, classes: DataFrame, docs: DataFrame, scratch: S.Scratch) -> DataFrame:
    """(node, n, h1, h2, text) of ``nodes``; where rows repeat a doc_id, with other texts of it."""
    wanted = scratch.write(classes.join(S.small(nodes), "node", "left_semi").select("node", F.col("rep").alias("doc_id"), "n", "h1", "h2"), "wanted")
    texts = scratch.write(docs.join(S.small(wanted), "doc_id").select("node", "n", "h1", "h2", "text"), "node-texts")
    return scratch.write(texts.dropDuplicates(["node", "text"]), "one-text-each") if texts.count() > wanted.count() else texts


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, scratch: S.Scratch, k: int, chunk: int = 256) -> DataFrame:
    """(a, b, na, nb, overlap) of distinct pairs of nodes, counted on the whole texts; each a's partners come in salted chunks."""
    texts = texts_of_nodes(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), classes, docs, scratch)
    heavy = pairs.groupBy("a").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts"))
    salted = pairs.join(heavy, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    left = salted.select("a", "part").distinct().join(texts, F.col("a") == F.col("node")).select("a", "part", F.lit(-1).cast("long").alias("b"), "n", "h1", "h2", "text")
    right = salted.join(texts, F.col("b") == F.col("node")).select("a", "part", "b", "n", "h1", "h2", "text")
    rows = left.unionByName(right).repartition("a", "part").sortWithinPartitions("a", "part", "b")

    def run(batches):
        key, mine = None, None
        for batch in batches:
            a, part, b, n, h1, h2 = (batch.column(i).to_numpy() for i in range(6))
            for first, end, data, offsets in K.pieces(batch.column(6)):
                d, h = shingle_sets(data, offsets, k)
                size, one, two = set_digests(d, h, end - first)
                own = (size == n[first:end]) & (one == h1[first:end]) & (two == h2[first:end])  # another text of the same doc_id is not the node's
                begin = np.searchsorted(d, np.arange(end - first + 1))
                out = []
                for i in np.flatnonzero(own):
                    x = h[begin[i] : begin[i + 1]]
                    if b[first + i] == -1:
                        key, mine = (a[first + i], part[first + i]), x
                    elif key == (a[first + i], part[first + i]):
                        at = np.minimum(np.searchsorted(mine, x), len(mine) - 1)
                        out.append((a[first + i], b[first + i], len(mine), len(x), int((mine[at] == x).sum())))
                if out:
                    yield S.batch(**{c: np.array(v, np.int64) for c, v in zip(("a", "b", "na", "nb", "overlap"), zip(*out))})

    S.ship(docs.sparkSession)
    out = scratch.write(rows.mapInArrow(run, "a long, b long, na long, nb long, overlap long"), "verified")
    scratch.drop(texts)
    return out


def deal(members: DataFrame, block: int) -> DataFrame:
    """``cell`` for each set: its pivot's, or the parts of a large cell in which the set meets all sets of other components."""
    own = F.xxhash64("node", F.lit(5))
    major, other = F.ceil(F.col("most") / block), F.greatest(F.ceil((F.col("sets") - F.col("most")) / block), F.lit(1))
    b, o = F.pmod(own, major), F.pmod(own, other)
    parts = F.when(F.col("sets") <= block, F.array(F.lit(0).cast("long")))
    parts = parts.when(F.col("comp") == F.col("major"), F.transform(F.sequence(F.lit(0).cast("long"), other - 1), lambda x: b * other + x))
    meet = F.transform(F.sequence(F.lit(0).cast("long"), major - 1), lambda x: x * other + o)
    among = F.transform(F.sequence(F.lit(0).cast("long"), other - 1), lambda x: (major + F.least(x, o)) * other + F.greatest(x, o))
    parts = parts.otherwise(F.concat(meet, among))
    return members.select("pivot", "n", "node", "comp", "known", F.explode(parts).alias("part")).select(F.xxhash64("pivot", "part").alias("cell"), "n", "node", "comp", "known")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row_key): rows that repeat both have one key."""
    return S.texts_of(docs).withColumn("row_key", S.row_key(F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))


def similar_sets(docs: DataFrame, k: int = 5, percent: int = 80, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame, S.Scratch]:
    """(membership, classes, links, scratch): doc_id, row_key, n, node of every document; node, rep; and enough exact links (a, b) of nodes to connect every component."""
    spark = docs.sparkSession
    scratch = S.Scratch(spark)
    docs = keyed(docs).where("doc_id is not null")
    often = spark.sparkContext.broadcast(frequent_shingles(docs, k))
    sets = scratch.write(indexed_sets(docs, k, percent, often), "sets")
    often.destroy()
    classes = sets.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"))
    classes = scratch.write(classes.select(F.monotonically_increasing_id().alias("node"), "*"), "classes")  # written: the ids stay
    names = classes.select("node", "rep", "n", "h1", "h2")
    membership = sets.select("doc_id", "row_key", "n", "h1", "h2").join(S.small(names.select("node", "n", "h1", "h2")), ["n", "h1", "h2"], "left").select("doc_id", "row_key", "n", "node")
    membership = scratch.write(membership, "membership")
    scratch.drop(sets)
    entries = classes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = scratch.write(entries.groupBy("token").agg(F.count("*").alias("entries")).where("entries > 1").select("token"), "shared")
    index = scratch.write(entries.join(shared, "token"), "index")  # grows with the corpus: never sent whole

    def links_of(checked: DataFrame) -> DataFrame:
        return checked.where(f"{100 + percent} * overlap >= {percent} * (na + nb)").select("a", "b")

    typical = scratch.write(index.groupBy("node").agg(F.count("*").alias("known")), "typical")
    pivot = index.join(S.small(typical), "node").groupBy("token").agg(F.max(F.struct("known", "node", F.col("n").cast("int").alias("n"), "pos")).alias("p"))
    met = index.join(pivot.select("token", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.pos").alias("pp")), "token")
    reach = F.expr(f"{100 + percent} * (1 + least(pos, pp) + least(n - 1 - pos, pn - 1 - pp)) >= {percent} * (n + pn)")
    members = met.groupBy("pivot", "node").agg(F.count_if(reach).alias("lists"), F.first("n").alias("n"), F.first("pn").alias("pn"))
    members = scratch.write(members, "members")
    # the pivots' round only has to find leaders: pairs that a twelfth of the smaller set's shingles point at
    pointed = members.where("node <> pivot and 12 * lists >= least(n, pn)").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    first = verified(scratch.write(pointed, "pivot-pairs"), names, docs, scratch, k)
    comps = connected_components(links_of(first), scratch)
    led = members.join(S.small(comps.select("node", F.col("component").alias("comp"))), "node", "left").select("pivot", "node", "n", F.coalesce("comp", "node").alias("comp"))
    kinds = led.groupBy("pivot", "comp").agg(F.count("*").alias("c")).groupBy("pivot").agg(F.count("*").alias("kinds"), F.sum("c").alias("sets"), F.max(F.struct("c", "comp")).alias("x"))
    mixed = scratch.write(kinds.where("kinds > 1").select("pivot", "sets", F.col("x.c").alias("most"), F.col("x.comp").alias("major")), "mixed")
    cells = scratch.write(deal(led.join(S.small(mixed), "pivot").join(S.small(typical), "node"), block), "cells")
    maps = scratch.write(bitmaps(texts_of_nodes(cells.select("node").distinct(), names, docs, scratch), k), "bitmaps")
    apart = cells.join(maps, "node").select("cell", "n", "node", "comp", "known", "bits").repartition("cell").sortWithinPartitions("cell", "n", "node")
    apart = apart.mapInArrow(close_pairs(percent), "a long, b long").distinct()
    apart = scratch.write(apart.join(first.select("a", "b"), ["a", "b"], "left_anti"), "apart-pairs")
    second = verified(apart, names, docs, scratch, k)
    links = comps.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(links_of(second))
    return membership, names, links, scratch


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 80, block: int = BLOCK, row_key: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``; on request its ``row_key`` and its ``group``, a component's own number (two components may share a component_id where rows share a doc_id; null for empty sets)."""
    membership, names, links, scratch = similar_sets(docs, k, percent, block)
    comps = connected_components(links, scratch)
    linked = scratch.write(names.select("node", "rep").join(S.small(comps), "node", "left").withColumn("component", F.coalesce("component", "node")), "linked")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = linked.join(S.small(scratch.write(least, "least")), "component").select("node", "component_id", F.col("component").alias("group"))
    out = membership.join(S.small(named), "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "row_key", "group")
    orphans = keyed(docs).where("doc_id is null")
    sizes = S.arrow_map(orphans, _sizes(k), "doc_id long, n_shingles long, row_key binary").withColumns({"component_id": F.lit(None).cast("long"), "group": F.lit(None).cast("long")})
    out = out.unionByName(sizes)
    return out if row_key else out.drop("row_key", "group")


def _sizes(k: int):
    def run(rows):
        for first, end, data, offsets in K.pieces(rows.column(1)):
            yield S.batch(doc_id=rows.column(0).slice(first, end - first), n_shingles=np.bincount(shingle_sets(data, offsets, k)[0], minlength=end - first).astype(np.int64), row_key=rows.column(2).slice(first, end - first))

    return run


#: DuckDB SQL for the digest rows.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[p:p + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b)::BIGINT AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY ALL
"""
