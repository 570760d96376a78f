"""Quality rules: per-document counts and n-gram perplexity bands.

A modified Kneser-Ney model over the last five characters is counted for each
language on every document.  Characters are whole code points (ASCII letters in lower
case, digits as one, white space as one), so what is counted grows with the corpus and
its scripts.  Spark counts the n-grams (each task pre-aggregates its own texts), and
derives continuation counts, discounts and probabilities level by level with grouped
sums and joins; nothing of it is in one place.  Every occurrence is scored without
itself (its count, its history's count and, where it was the only one, its place among
the lower orders' continuations less one), as else each text's own n-grams would be
known.  So the only probability that a text needs is that of its n-grams of full
length, each of which the corpus has: the model is one value for each, stored as
arrays sorted by n-gram hash and sent to the tasks, in as many passes over disjoint
shards as ``model_rows`` asks for.

A document is rejected when its log-perplexity lies outside its language's band:
median -/+ ``width`` times the spread, the spread being the scaled distance from the
median to the lower or upper quartile.

Defined results: null text has no words and fails the base rules; a null language
is a language of its own; a document without characters has no perplexity and the
band does not apply; repeated rows are scored each by itself and count each;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm import scratch as S

ORDER = 5
#: Bits of a code point; an n-gram is (a, b): its first two and its last three.
_CP = 21
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "#*$%&|<>"]] = True
#: n-grams that a task gathers before it merges them.
PENDING = 2_000_000


def symbols(points: np.ndarray) -> np.ndarray:
    """Code points plus one (0 is the text start); letters of ASCII in lower case, digits as 0, white space as the space."""
    out = points.astype(np.uint64) + np.uint64(1)
    ascii_form = np.arange(1, 129, dtype=np.uint64)
    ascii_form[65:91] += np.uint64(32)
    ascii_form[48:58] = 49
    ascii_form[9:14] = 33
    low = points < 128
    out[low] = ascii_form[points[low]]
    return out


def text_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b of every character with its history, first n-gram of each text) of a piece."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = (data & 0xC0) != 0x80
    first = np.concatenate([[0], np.cumsum(lead)])[offsets]
    if len(points) != first[-1]:  # malformed bytes: each text by itself
        texts = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offsets[:-1], offsets[1:])]
        first, points = np.concatenate([[0], np.cumsum([len(t) for t in texts])]), np.concatenate(texts)
    symbol = symbols(points)
    place = np.arange(len(symbol)) - np.repeat(first[:-1], np.diff(first))
    halves = [np.zeros(len(symbol), np.uint64), symbol.copy()]
    for j in range(1, ORDER):
        before = np.zeros_like(symbol)
        before[j:] = symbol[:-j]
        before[place < j] = 0
        halves[j < 3] |= before << np.uint64(_CP * (j % 3))
    return halves[0], halves[1], first


def gram_hash(lang: np.ndarray | np.uint64, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return K.mix64(K.mix64(b ^ lang) + a * np.uint64(0x9E3779B97F4A7C15))


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    words = K.Words(data, offsets)
    doc, n = words.doc(), np.diff(words.first)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    marks = np.concatenate([[0], np.cumsum(_MARKS[data])])
    three = K.grams(words.hash, 3)
    starts = np.flatnonzero(K.same_text(words.first, 3, doc))
    repeated = np.zeros(len(doc), bool)
    if len(starts):
        _, which, count = np.unique(three[starts] ^ K.mix64(doc[starts].astype(np.uint64)), return_inverse=True, return_counts=True)
        repeated = K.cover(starts[count[which] > 1], 3, len(doc))
    lines = np.zeros(len(n), np.int64)
    for i in range(len(n)):
        rows = data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n")
        if len(rows) > 1:
            worded = [x for x in rows if x and x.strip(b" \t\n\r\x0b\x0c")]
            lines[i] = len(worded) - len(set(worded))
    return {
        "n_words": n, "word_chars": K.per_text(lead[words.end] - lead[words.start], words.first), "n_symbols": marks[offsets[1:]] - marks[offsets[:-1]],
        "n_dup_lines": lines, "n_repeat_words": K.per_text(repeated.astype(np.int64), words.first),
    }


def count_grams(docs: DataFrame) -> DataFrame:
    """(l, a, b, c) over every text of (text, l); partial counts are made in the tasks."""

    def run(batches):
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0

        def merged():
            l, a, b, n = (np.concatenate(x) for x in zip(*parts))
            h = gram_hash(l, a, b)
            _, one, which = np.unique(h, return_index=True, return_inverse=True)
            return l[one], a[one], b[one], np.bincount(which, n, minlength=len(one)).astype(np.int64)

        for rows in batches:
            langs = K.unsigned(rows.column(1).to_numpy())
            for first, end, data, offsets in K.pieces(rows.column(0)):
                a, b, begin = text_grams(data, offsets)
                if not len(a):
                    continue
                l = np.repeat(langs[first:end], np.diff(begin))
                _, one, n = np.unique(gram_hash(l, a, b), return_index=True, return_counts=True)
                parts.append((l[one], a[one], b[one], n))
                held += len(one)
                if held > PENDING and held > 2 * len(parts[0][0]):  # the first part is what was merged before
                    parts = [merged()]
                    held = len(parts[0][0])
        if parts:
            l, a, b, n = merged()
            order = np.lexsort((b, a, l))
            for at in range(0, len(n), 100_000):
                own = order[at : at + 100_000]
                yield S.batch(l=K.signed(l[own]), a=K.signed(a[own]), b=K.signed(b[own]), c=n[own])
        S.release()

    S.ship(docs.sparkSession)
    return docs.mapInArrow(run, "l long, a long, b long, c long").groupBy("l", "a", "b").agg(F.sum("c").alias("c"))


def _shorter(k: int) -> tuple[Column, Column]:
    """(a, b) of a k-gram without its first symbol."""
    a, b = F.col("a"), F.col("b")
    keep = (1 << (_CP * ((k - 1) if k <= 3 else (k - 4)))) - 1
    return (F.lit(0).cast("long"), b.bitwiseAND(keep)) if k <= 3 else (a.bitwiseAND(keep), b)


def _history(df: DataFrame) -> tuple[Column, Column]:
    """(a, b) of an n-gram without its last symbol."""
    return F.shiftright("a", _CP), F.shiftleft(F.col("a").bitwiseAND((1 << _CP) - 1), 2 * _CP).bitwiseOR(F.shiftright("b", _CP))


def _discounts() -> list[Column]:
    """The three discounts from the counts of counts."""
    n = [F.greatest(F.count_if(F.col("c") == i), F.lit(1)).cast("double") for i in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    raw = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2])
    return [F.least(F.greatest(x, F.lit(0.05)), F.lit(top)) for x, top in zip(raw, (0.95, 1.9, 2.85))]


def kneser_ney(counts: DataFrame, scratch: S.Scratch) -> DataFrame:
    """(l, a, b, p, q) of every n-gram of full length: its probability, and that without one occurrence of it."""
    levels = {ORDER: counts}
    for k in range(ORDER, 1, -1):  # continuation counts: distinct symbols that come before
        a, b = _shorter(k)
        levels[k - 1] = scratch.write(levels[k].groupBy("l", a.alias("a"), b.alias("b")).agg(F.count("*").alias("c")), f"level-{k - 1}")
    sizes = scratch.write(levels[1].groupBy("l").agg((F.count("*") + 1).alias("v")), "alphabets")
    lower = None
    for k in range(1, ORDER + 1):
        level, (ha, hb), (sa, sb) = levels[k], _history(levels[k]), _shorter(k)
        d = S.small(scratch.write(level.groupBy("l").agg(F.array(*_discounts()).alias("d")), f"discounts-{k}"))
        c = F.col("c")
        known = level.withColumn("ha", ha if k > 1 else F.lit(0).cast("long")).withColumn("hb", hb if k > 1 else F.lit(0).cast("long"))
        history = known.groupBy("l", "ha", "hb").agg(F.sum("c").alias("n"), *[F.count_if(x).alias(t) for t, x in (("t1", c == 1), ("t2", c == 2), ("t3", c > 2))])
        known = known.join(history, ["l", "ha", "hb"]).join(d, "l")
        if lower is None:
            known = known.join(S.small(sizes), "l").withColumn("lp", 1.0 / F.col("v")).withColumn("lq", 1.0 / F.col("v"))
        else:
            known = known.withColumn("sa", sa).withColumn("sb", sb).join(lower.select("l", F.col("a").alias("sa"), F.col("b").alias("sb"), F.col("p").alias("lp"), F.col("q").alias("lq")), ["l", "sa", "sb"])
        dd = [F.col("d")[i] for i in range(3)]
        n, t = F.col("n"), [F.col(x).cast("double") for x in ("t1", "t2", "t3")]
        cut = lambda x: F.when(x <= 0, 0.0).when(x == 1, 1 - dd[0]).when(x == 2, 2 - dd[1]).otherwise(x - dd[2])
        back = dd[0] * t[0] + dd[1] * t[1] + dd[2] * t[2]
        moved = F.when(c == 1, -dd[0]).when(c == 2, dd[0] - dd[1]).when(c == 3, dd[1] - dd[2]).otherwise(0.0)  # one occurrence less changes the n-gram's own discount
        p = (cut(c) + back * F.col("lp")) / n
        q = F.when(n == 1, F.col("lq")).otherwise((cut(c - 1) + (back + moved) * F.when(c == 1, F.col("lq")).otherwise(F.col("lp"))) / F.greatest(n - 1, F.lit(1)))
        lower = scratch.write(known.select("l", "a", "b", p.alias("p"), q.alias("q")), f"model-{k}")
    return lower


def _shard(l, b, shards: int):
    """Which shard an n-gram's value is in; numpy and Spark columns alike."""
    if isinstance(b, Column):
        return F.pmod(F.pmod(l, F.lit(shards)) + F.pmod(b, F.lit(shards)), F.lit(shards))
    return (l.view(np.int64) % shards + b.view(np.int64) % shards) % shards


def _scored(docs: DataFrame, table, shards: int, shard: int) -> DataFrame:
    """Base counts and the summed log-probability of one shard's n-grams of each row of (doc_id, text, lang, l, key)."""

    def run(rows):
        at, value = table.value
        langs = K.unsigned(rows.column(3).to_numpy())
        for first, end, data, offsets in K.pieces(rows.column(1)):
            counts = base_counts(data, offsets)
            a, b, begin = text_grams(data, offsets)
            l = np.repeat(langs[first:end], np.diff(begin))
            distinct, one, which = np.unique(gram_hash(l, a, b), return_index=True, return_inverse=True)
            own = _shard(l[one], b[one], shards) == shard
            log_p = np.zeros(len(distinct))
            log_p[own] = value[np.searchsorted(at, distinct[own])]
            part = slice(first, end)
            kept = {c: rows.column(i)[part] for c, i in (("doc_id", 0), ("lang", 2), ("key", 4))}
            yield S.batch(**kept, **{k: v.astype(np.int64) for k, v in counts.items()}, n_symbols_scored=np.diff(begin).astype(np.int64), log_p=K.per_text(log_p[which] if len(which) else log_p, begin))

    return S.arrow_map(docs, run, "doc_id long, lang string, key binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_symbols_scored long, log_p double")


def quality_rules(docs: DataFrame, *, width: float = 8.0, min_words: int = 50, repeat_share: int = 50, model_rows: int = 8_000_000) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, log_ppl and its band."""
    spark = docs.sparkSession
    scratch = S.Scratch(spark)
    digest = F.md5(F.concat(F.coalesce("text", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("-"))).cast("binary"))
    docs = S.texts_of(docs, "lang").withColumn("lang", F.col("lang").cast("string"))
    docs = docs.withColumn("l", F.xxhash64(F.col("lang").isNull(), "lang")).withColumn("key", S.row_key(F.col("doc_id"), digest))
    model = kneser_ney(scratch.write(count_grams(docs.select("text", "l")), "grams"), scratch).select("l", "a", "b", F.log("q").cast("float").alias("log_q"))
    shards = max(1, -(-model.count() // model_rows))
    rows, more = None, []
    for shard in range(shards):
        t = model.where(_shard(F.col("l"), F.col("b"), shards) == shard).toArrow()  # about model_rows values
        h = gram_hash(*(K.unsigned(t.column(x).to_numpy()) for x in ("l", "a", "b")))
        order = np.argsort(h)
        table = spark.sparkContext.broadcast((h[order], t.column("log_q").to_numpy()[order]))
        part = scratch.write(_scored(docs, table, shards, shard), "scored")
        table.destroy()
        if rows is None:
            rows = part
        else:
            more.append(part.groupBy("key").agg(F.first("log_p").alias("more")))  # rows of one key have one value
    for part in more:
        rows = rows.join(part, "key").withColumn("log_p", F.col("log_p") + F.col("more")).drop("more")
    rows = rows.withColumn("log_ppl", F.when(F.col("n_symbols_scored") > 0, -F.col("log_p") / F.col("n_symbols_scored")))
    q = rows.where("log_ppl is not null").groupBy("lang").agg(F.percentile_approx("log_ppl", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000).alias("q"))
    low, mid, high = (F.col("q")[i] for i in range(3))
    spread = lambda gap: width * F.greatest(1.4826 * gap, F.lit(0.02))
    band = scratch.write(q.select(F.col("lang").alias("b_lang"), (mid - spread(mid - low)).alias("low"), (mid + spread(high - mid)).alias("high")), "bands")
    out = rows.join(S.small(band), F.col("lang").eqNullSafe(F.col("b_lang")), "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_share * F.col("n_words"))
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & inside).alias("kept"), "log_ppl", "low", "high")


def naive_log_perplexities(texts: list[tuple[str, str | None]]) -> list[float | None]:
    """Brute force for tests: of each (text, language), every character scored without itself."""
    from collections import Counter, defaultdict
    from math import log

    def grams(text: str) -> list[tuple[int, ...]]:
        s = [0] * (ORDER - 1) + symbols(np.array([ord(c) for c in text], np.uint32)).tolist()
        return [tuple(s[i : i + ORDER]) for i in range(len(text))]

    out: list[float | None] = [None] * len(texts)
    for lang in {l for _, l in texts}:
        own = [(i, grams(t)) for i, (t, l) in enumerate(texts) if l == lang]
        counts = {ORDER: Counter(g for _, gs in own for g in gs)}
        for k in range(ORDER - 1, 0, -1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        alphabet = len(counts[1]) + 1
        model = {}
        for k, c in counts.items():
            n = [max(1, sum(v == i for v in c.values())) for i in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            raw = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2])
            heads = defaultdict(list)
            for g, v in c.items():
                heads[g[:-1]].append(v)
            model[k] = c, [min(max(x, 0.05), top) for x, top in zip(raw, (0.95, 1.9, 2.85))], heads

        def probability(g: tuple[int, ...], less: bool) -> float:
            if not g:
                return 1 / alphabet
            c, d, heads = model[len(g)]
            others = list(heads[g[:-1]])
            v = c[g]
            if less:
                others.remove(v)
                others += [v - 1] if v > 1 else []
            if not others:
                return probability(g[1:], less)
            cut = sum(d[min(x, 3) - 1] for x in others)
            mine = v - less
            return ((mine - d[min(mine, 3) - 1] if mine else 0.0) + cut * probability(g[1:], less and v == 1)) / sum(others)

        for i, gs in own:
            if gs:
                out[i] = -sum(log(probability(g, True)) for g in gs) / len(gs)
    return out
