"""Brute-force checks and edge cases of the corpus operators."""

import collections
import hashlib
import math
import random
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import oracle
from tessera.llm import decontaminate as D
from tessera.llm import induced, mixing, ngram_join, queries, revisit, rules, substring, suffix, tokencount, toxicity
from tessera.llm.components import connected_components
from tessera.llm.quality import QualityClassifier, score_quality
from tessera.llm.scratch import Scratch

DOC = "doc_id long, text string, lang string, source string, n_chars long, n long, hash string, low long"


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing column names."""
    rng = random.Random(4)
    passage, long = words(rng, 70), words(rng, 3000)
    texts = ["", None, "   \n ", passage, passage, words(rng, 20) + " " + passage + " " + words(rng, 30), long, long + " tail", "ha " * 120, "é" * 700, "one two three", words(rng, 60), passage.upper(), "x" * 900]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else "s", None, 1, "h", 2) for i, t in enumerate(texts)]
    rows += [rows[5], (None, passage, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def texts(df):
    return [r["text"] for r in df.select("text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    oracle.check(spark, oracle.connect(sf), sf, name, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_token_counts(spark, sf, edge_docs, no_docs):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    special = spark.createDataFrame([(1, "a<|endoftext|>b <|startoftext|>"), (2, "İÉ é \x85 x y don't 12345")], "doc_id long, text string")
    for docs in (edge_docs, special, spark.read.parquet(f"{sf}/documents.parquet")):
        pdf = docs.select("doc_id", "text").toPandas()
        want = tokencount.naive_token_counts(list(pdf.text), path)
        for shared, cache in ((10**6, 10**6), (40, 500), (0, 1)):  # all frequent words shared, few, none
            got = tokencount.count_tokens(docs, path, shared_entries=shared, cache_entries=cache).toPandas()
            assert sorted(zip(got.doc_id.fillna(-1), got.n_tokens)) == sorted(zip(pdf.doc_id.fillna(-1), want))
            assert sorted(got.n_bytes) == sorted(len((t or "").encode()) for t in pdf.text)
            assert (got.over_limit == (got.n_tokens > 2048)).all()
    assert tokencount.count_tokens(no_docs, path).count() == 0


def test_frequent_pretokens_are_counted_over_all_texts(spark):
    docs = spark.createDataFrame([(1, "b a  a\tc a"), (2, "a b b"), (3, None), (4, "zz"), (5, "zz zz d")], "doc_id long, text string").coalesce(1)
    got = {bytes(r.word).decode(): r.n for r in tokencount.frequent_pretokens(docs, 10).collect()}
    assert got == {"a": 4, "b": 3, "zz": 3}
    assert {bytes(r.word).decode() for r in tokencount.frequent_pretokens(docs, 1).collect()} == {"a"}


def naive_rules(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, g in enumerate(tri) if tri.count(g) > 1 for j in (i, i + 1, i + 2)} if len(tri) < 500 else None
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), None if hit is None else len(hit)


def test_quality_rules(spark, edge_docs, no_docs):
    pdf = edge_docs.select("doc_id", "text").toPandas()
    got = rules.quality_rules(edge_docs).toPandas()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    want = sorted(key(naive_rules(t)) for t in pdf.text)
    have = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, -1 if r.n_words - 2 >= 500 else r.n_repeat_words) for r in got.itertuples())
    assert have == want
    assert (got.base_failed == ((got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words))).all()
    assert not (got.kept & got.base_failed).any()
    assert rules.quality_rules(no_docs).count() == 0


def test_word_order_is_judged(spark):
    rng = random.Random(8)
    rows = []
    for lang, letters in (("xx", "abcdefghijkl"), ("zz", "天地玄黃宇宙洪荒日月盈昃")):
        names = ["".join(rng.choice(letters) for _ in range(4)) for _ in range(300)]
        after = {w: rng.sample(names, 4) for w in names}
        for i in range(250):
            w = [rng.choice(names)]
            while len(w) < 150:
                w.append(rng.choice(after[w[-1]]))
            if i < 5:
                rng.shuffle(w)
            elif i < 10:
                w = [x if rng.random() < 0.5 else "".join(rng.sample(x, len(x))) for x in w]
            rows.append((len(rows), " ".join(w), lang, i < 10))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, planted boolean")
    got = {r.doc_id: r for r in rules.quality_rules(docs).collect()}
    assert len(got) == len(rows)
    assert [i for i, _, _, planted in rows if got[i].kept == planted and not got[i].base_failed] == []
    assert sum(not got[i].base_failed for i, *_ in rows) > 0.9 * len(rows)


def test_perplexity_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [("".join(rng.choice("abcdé 1中") for _ in range(rng.randrange(60))), rng.choice(["x", "y", None])) for _ in range(60)]
    texts += [("A quick test of 12 things.\n", "x"), ("", "x"), ("a quick test of 99 things. ", "x")]
    docs = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(texts)], "doc_id long, text string, lang string")
    want = rules.naive_log_perplexities(texts)
    for model_rows in (10**6, 100):  # at once, and in shards
        got = {r.doc_id: r.log_ppl for r in rules.quality_rules(docs, model_rows=model_rows).collect()}
        assert [got[i] is None for i in range(len(texts))] == [x is None for x in want]
        assert all(got[i] == pytest.approx(x, abs=1e-5) for i, x in enumerate(want) if x is not None)


def test_kneser_ney_is_a_distribution(spark):
    """Over the symbols that follow a history: their probabilities and the mass kept back for others sum to one."""
    rng = np.random.default_rng(1)
    raw = "".join(rng.choice(list("abc ")) for _ in range(40000))
    counts = rules.count_grams(spark.createDataFrame([(raw, 7)], "text string, l long"))
    model = rules.kneser_ney(counts, Scratch(spark)).toPandas()
    assert ((model.p > 0) & (model.p < 1) & (model.q > 0) & (model.q < 1)).all()
    history = [(a >> 21, ((a & (1 << 21) - 1) << 42) | b >> 21) for a, b in zip(model.a, model.b)]
    total = model.groupby(pd.Series(history)).p.sum()
    size = pd.Series(history).value_counts()
    full = total[size[total.index] == 4]  # all four symbols follow: only the one kept for unseen symbols is missing
    assert len(full) > 50 and (full <= 1).all() and (full > 0.999).all()


def test_bands_reject_on_both_sides(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnop"
    names = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(names) for _ in range(120)), "xx") for i in range(300)]
    rows += [(1000 + i, " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(120)), "xx") for i in range(3)]  # letters by chance
    common = [rng.choice(names) for _ in range(3)]
    rows += [(2000 + i, " ".join(rng.choice(common) + rng.choice(common) for _ in range(200)), "xx") for i in range(3)]  # nearly nothing but three names
    got = rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).toPandas().set_index("doc_id").sort_index()
    assert (got.log_ppl.loc[1000:1002] > got.high.loc[1000:1002]).all() and (got.log_ppl.loc[2000:2002] < got.low.loc[2000:2002]).all()
    assert not got.kept.loc[1000:2002].any() and got.kept.loc[:299].mean() > 0.99 and not got.base_failed.loc[:1002].any()


def test_induced_sorting():
    rng = random.Random(2)
    for _ in range(300):
        x = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(40))] * rng.choice([1, 2])
        sa, lcp = induced.suffixes(np.array(x, np.int64), memory=rng.choice([3, 6, 10**6]))
        assert (sa.tolist(), lcp.tolist()) == induced.naive_suffixes(x)


def test_induced_sorting_with_string_ends():
    rng = random.Random(3)
    for _ in range(200):
        strings = [[rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(25))] for _ in range(rng.randrange(1, 6))] * rng.choice([1, 2])
        k = len(strings)
        x = [c for i, s in enumerate(strings) for c in [*(b + k for b in s), i]]
        sa, lcp = induced.suffixes(np.array(x, np.int64), memory=rng.choice([3, 10**6]), ends=k)
        assert (sa.tolist(), lcp.tolist()) == induced.naive_suffixes(x)


def test_induced_sorting_beyond_memory():
    """A shard 200 times as large as the memory given: arrays and queues lie on disk, and the result is the same."""
    rng = np.random.default_rng(5)
    block = rng.integers(0, 26, 3000)
    x = np.concatenate([rng.integers(0, 26, 8000), block, rng.integers(0, 26, 8000), block, np.zeros(500, np.int64)])
    small, large = induced.suffixes(x, memory=100), induced.suffixes(x, memory=10**7)
    assert isinstance(small[0], np.memmap) and not isinstance(large[0], np.memmap)
    assert (small[0] == large[0]).all() and (small[1] == large[1]).all()
    raw = [bytes(x[i : i + 4000].astype(np.uint8)) for i in large[0][::500]]
    assert raw == sorted(raw) and large[1].max() >= 3000


def test_substring_colourings_are_chosen_over_all_texts(spark, edge_docs, no_docs):
    singles = edge_docs.select("doc_id", "text")
    chosen = substring.choose_colourings(singles)
    assert chosen == substring.choose_colourings(singles.repartition(7)) and len(chosen) == substring.ROUNDS
    assert len(substring.choose_colourings(no_docs.select("doc_id", "text"))) == substring.ROUNDS


def test_byte_dedup(spark, edge_docs, no_docs):
    for docs in (edge_docs, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        pdf = docs.select("doc_id", "text").toPandas()
        got = suffix.dedup_bytes(spark.createDataFrame(pdf.astype({"doc_id": "Int64"}).astype(object).where(pdf.notna(), None), "doc_id long, text string")).toPandas()
        want = suffix.naive_dedup([None if t is None else t for t in pdf.text], 400)
        assert sorted(zip(got.n_bytes, got.n_removed, got.n_spans, got.kept_sha256)) == sorted(want)
    assert suffix.dedup_bytes(no_docs).count() == 0


def one_passage(n, rng):
    """Texts around one passage or parts of it, each with a border of its own that may share some bytes with others'."""
    letters = lambda k: "".join(rng.choice("ab") for _ in range(k))
    passage = "".join(rng.choice("abcdefgh ") for _ in range(460))
    return [letters(rng.randrange(150, 260)) + passage[rng.choice([0, 0, 5, 40, 70]) : len(passage) - rng.choice([0, 0, 3, 20, 61])] + letters(rng.randrange(150, 260)) for _ in range(n)]


def test_byte_dedup_deals_out_one_anchors_strings(spark, tmp_path, monkeypatch):
    """No task gets more than 256 different strings of an anchor, and no link is lost."""
    sort = suffix._sort_shard

    def seen(batches, *rest):
        batches = list(batches)
        counts = collections.Counter(k for b in batches for k in b.column(0).to_pylist())
        (tmp_path / uuid.uuid4().hex).write_text(str(max(counts.values(), default=0)))
        yield from sort(iter(batches), *rest)

    monkeypatch.setattr(suffix, "_sort_shard", seen)
    texts = one_passage(700, random.Random(8))
    got = suffix.dedup_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == suffix.naive_dedup(texts, 400)
    assert 0 < max(int(f.read_text()) for f in tmp_path.iterdir()) <= 256


@pytest.mark.parametrize("most", [1, 2, 7])
def test_byte_dedup_in_finer_parts(spark, most):
    """Every anchor of several strings is cut, once or twice."""
    rng = random.Random(9)
    base = "".join(rng.choice("abc") for _ in range(1500))
    cuts = [base[a : a + rng.randrange(380, 1100)] for a in (rng.randrange(900) for _ in range(30))]
    edited = ["".join(rng.choice("xyz") if rng.random() < 0.002 else c for c in t) for t in cuts]
    texts = one_passage(40, rng) + cuts + edited + ["ha " * n for n in (133, 134, 135, 300, 700)] + ["a" * n for n in (399, 400, 401, 1000)] + [None, "", cuts[0], "é" * 500]
    got = suffix.dedup_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), most=most).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == suffix.naive_dedup(texts, 400)


def naive_substring(rows, window=50):
    toks = [(d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in rows]
    first = {}
    for d, w in toks:
        for i in range(len(w) - window + 1):
            if d is not None:
                g = tuple(w[i : i + window])
                first[g] = min(first.get(g, d), d)
    out = []
    for d, w in toks:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_substring_dedup(spark, edge_docs, no_docs):
    rng = random.Random(9)
    shared, runs = words(rng, 90), "ha " * 70
    rows = [(i, words(rng, 15) + " " + (shared[rng.randrange(100) :] if i % 3 else runs[: rng.randrange(150, 210)]) + " " + words(rng, rng.randrange(60))) for i in range(60)]
    rows += [(100, "a b " * 40), (101, "z a b " + "a b " * 50), (102, "q " * 49 + "r"), (103, "q " * 60)]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string"), edge_docs):
        got = substring.dedup_substrings(docs).toPandas()
        want = naive_substring([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        assert sorted(zip(got.n_words, got.n_removed, got.kept_sha256)) == want
    assert substring.dedup_substrings(no_docs).count() == 0


def naive_components(rows):
    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").replace(" ", "_")
        w = re.findall("[^\x20\x09-\x0d]+", w)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = find(a), find(b)
                up[max(ra, rb)] = min(ra, rb)
    return sorted((d, len(s), find(d)) for d, s in sets)


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 3])
def test_ngram_join(spark, block):
    rng = random.Random(3)
    base = [words(rng, rng.randrange(8, 120)).split() for _ in range(6)]
    rows = []
    for i in range(70):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    rows.append((70, " ".join(base[0][:4])))
    rows.append((71, " ".join(base[0][:4]).upper()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.ngram_components(docs, block=block).toPandas()
    assert sorted(map(tuple, got[["doc_id", "n_shingles", "component_id"]].itertuples(index=False))) == naive_components(rows)


def test_ngram_join_pair_of_rare_and_common_shingles(spark):
    """Two documents that share 8 rare shingles and 172 that many short documents have as well."""
    base = [f"w{i}" for i in range(204)]
    a, b = list(base), list(base)
    for at in (5, 30, 55, 80):
        a[at], b[at] = f"a{at}", f"b{at}"
    rows = [(1, " ".join(a)), (2, " ".join(b))]
    for i in range(1200):
        at = 12 + (i * 7) % 180
        rows.append((100 + i, " ".join([*base[at : at + 6], f"z{i}", f"y{i}", f"x{i}"])))
    want = naive_components(rows)
    assert dict((d, c) for d, _, c in want)[2] == 1
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), block=50).toPandas()
    assert sorted(map(tuple, got[["doc_id", "n_shingles", "component_id"]].itertuples(index=False))) == want


def test_ngram_join_large_family(spark):
    """One text edited here and there 300 times, with sub-families; long lists with many components."""
    rng = random.Random(8)
    base = words(rng, 140).split()
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 6, 7, 9, 12])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), block=64).toPandas()
    assert sorted(map(tuple, got[["doc_id", "n_shingles", "component_id"]].itertuples(index=False))) == naive_components(rows)


def test_ngram_join_repeated_ids(spark):
    """Rows that share a doc_id but not a text are sets of their own."""
    one, two = " ".join(f"p{i}" for i in range(60)), " ".join(f"q{i}" for i in range(60))
    rows = [(5, one), (5, two), (7, one + " x"), (9, two + " y"), (5, one), (3, "else")]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(3, 1, 3), (5, 56, 5), (5, 56, 5), (5, 56, 5), (7, 57, 5), (9, 57, 5)]


def test_ngram_join_short_and_long_lists(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(204)]
    rows = []
    for family in range(53):
        slots = rng.sample(range(18), 8)

        def edit(w, slot, width, name):
            at = 6 + 11 * slot
            w[at : at + width] = [f"{name}x{j}" for j in range(width)]

        for member in range(3):
            w = list(base)
            edit(w, slots[0], 2, f"f{family}a")
            edit(w, slots[1], 2, f"f{family}b")
            edit(w, slots[2 + 2 * member], 1, f"f{family}m{member}a")
            edit(w, slots[3 + 2 * member], 2, f"f{family}m{member}b")
            rows.append((len(rows), " ".join(w)))
    want = naive_components(rows)
    assert len({c for _, _, c in want}) < len(rows) / 2
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert sorted(map(tuple, got[["doc_id", "n_shingles", "component_id"]].itertuples(index=False))) == want


def test_ngram_join_edges(spark, edge_docs, no_docs):
    got = ngram_join.ngram_components(edge_docs).where("doc_id is not null").distinct().toPandas()
    want = naive_components({(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()})
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(set(want))
    assert ngram_join.ngram_components(edge_docs).count() == edge_docs.count()
    assert ngram_join.ngram_components(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    got = dict(connected_components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark)).distinct().collect())
    up = {}
    for a, b in pairs:
        up.setdefault(a, {a}), up.setdefault(b, {b})
        if up[a] is not up[b]:
            both = up[a] | up[b]
            for x in both:
                up[x] = both
    assert got == {x: min(s) for x, s in up.items() if len(s) > 1}


def test_decontamination_edges(spark, edge_docs, no_docs):
    passage = next(r.text for r in edge_docs.collect() if r.doc_id == 3)
    bench = spark.createDataFrame([(1, passage[100:250]), (1, passage[100:250]), (2, "One TWO three"), (3, ""), (None, passage), (4, None)], "item_id long, text string")
    got = {r.doc_id: r for r in D.decontaminate(edge_docs, bench)[0].collect()}
    assert got[3].n_items == 1 and got[5].contaminated and got[12].n_hit == got[3].n_hit > 0
    assert got[10].n_hit == 3 and got[10].items_sha256 == hashlib.sha256(b"2").hexdigest()
    assert not got[0].contaminated and got[1].n_words == 0 and got[8].n_hit == 0
    assert D.decontaminate(edge_docs, bench)[0].count() == edge_docs.count()
    assert D.decontaminate(no_docs, bench)[0].count() == 0
    assert D.decontaminate(edge_docs, bench.limit(0))[0].where("contaminated").count() == 0


def accuracy(scored, labels, label):
    m = scored.toPandas().merge(labels.toPandas(), on="doc_id")
    m = m[m.held_out]
    return (m.predicted == m[label]).mean()


def test_quality_classifier(spark, edge_docs, no_docs, no_labels):
    d, l = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    assert accuracy(score_quality(d, l), l, "quality") > 0.93
    model = QualityClassifier().fit(edge_docs, no_labels)
    assert {r.score for r in model.score(edge_docs).collect()} == {0.5}
    assert model.keep(edge_docs, 0.4).columns == edge_docs.columns
    assert score_quality(no_docs, no_labels).count() == 0


def test_toxicity(spark, edge_docs, no_docs, no_labels):
    d, l = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    assert accuracy(toxicity.score_toxicity(d, l), l, "toxic") > 0.95
    got = toxicity.score_toxicity(edge_docs, no_labels)
    assert got.where("score between 0 and 1").count() == edge_docs.count()
    assert toxicity.score_toxicity(no_docs, no_labels).count() == 0


def test_toxicity_has_one_training_rule(spark, monkeypatch):
    rules_seen, train = [], toxicity.L.train_ftrl

    def spy(rows, *args, l1, epochs, **more):
        rules_seen.append((round(l1 / len(rows), 9), epochs))
        return train(rows, *args, l1=l1, epochs=epochs, **more)

    monkeypatch.setattr(toxicity.L, "train_ftrl", spy)
    for sf, least in (("sf0.01", 0.87), ("sf0.1", 0.95)):
        d, l = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
        assert accuracy(toxicity.score_toxicity(d, l), l, "toxic") > least
    assert len(set(rules_seen)) == 1


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.2
    votes = np.stack([np.where(rng.random(20000) < a, np.where(y, 2, 1), np.where(y, 1, 2)) for a in (0.95, 0.9, 0.85, 0.8)], 1)
    votes = np.concatenate([votes, votes[:, 3:]], 1)  # a voter that repeats another
    pattern, n = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.LabelModel(pattern, n.astype(float))
    assert model.accuracies() == pytest.approx([0.95, 0.9, 0.85, 0.8, 0.8], abs=0.06)
    assert model.dependence[3, 4] == model.dependence[~np.eye(5, dtype=bool)].max()


def test_ftrl_equals_plain_loop():
    """Training, coordinate by coordinate, and a score as a sparse dot product."""
    from tessera.llm import linear

    rng = np.random.default_rng(2)
    rows = []
    for _ in range(60):
        slot = np.sort(rng.choice(64, rng.integers(1, 9), replace=False))
        rows.append((slot, rng.random(len(slot)), float(rng.random() < (0.8 if 3 in slot else 0.3))))
    got, intercept = linear.train_ftrl(rows, 6, alpha=0.4, beta=1.0, l1=0.05, l2=0.01, epochs=3, seed=5)
    z, n, order = [0.0] * 64, [0.0] * 64, np.random.default_rng(5)
    mean = sum(y for _, _, y in rows) / len(rows)
    b, g2 = math.log(mean / (1 - mean)), 0.0

    def weight(i):
        if abs(z[i]) <= 0.05:
            return 0.0
        return -(z[i] - math.copysign(0.05, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.4 + 0.01)

    for _ in range(3):
        for r in order.permutation(len(rows)):
            slot, value, y = rows[r]
            w = [weight(i) for i in slot]
            p = 1 / (1 + math.exp(-(b + sum(a * v for a, v in zip(w, value)))))
            for i, v, a in zip(slot, value, w):
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.4 * a
                n[i] += g * g
            g2 += (p - y) ** 2
            b -= 0.1 * (p - y) / (1 + math.sqrt(g2))
    assert got == pytest.approx([weight(i) for i in range(64)], abs=1e-6) and intercept == pytest.approx(b)


def test_quality_scores_are_dot_products(spark, sf):
    from tessera.llm import linear
    from tessera.llm.kernels import pieces

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = QualityClassifier().fit(docs, labels)
    got = {r.doc_id: r.score for r in model.score(docs).collect()}
    for doc_id, text in docs.select("doc_id", "text").limit(20).collect():
        for _, _, data, offsets in pieces(pa.array([text], pa.string())):
            _, slot, value = linear.normalised(*linear.style_features(data, offsets), model.bits, 1)
            x = model.intercept + sum(float(model.weights[s]) * float(v) for s, v in zip(slot, value))
            assert got[doc_id] == pytest.approx(1 / (1 + math.exp(-x)), abs=1e-6)


def test_mixing_exponent_equals_a_plain_search(spark):
    shares = np.array([0.6, 0.25, 0.1, 0.04, 0.01])
    totals = spark.createDataFrame([(int(1e6 * s),) for s in shares], "tokens long")

    def entropy(a):
        w = shares**a / (shares**a).sum()
        return -(w * np.log(w)).sum()

    def passes(a):
        return (shares**a / (shares**a).sum() / shares).max()

    grid = np.linspace(0, 1, 200_001)
    for target in (0.7, 0.9, 0.97):
        want = max(a for a in grid if entropy(a) >= target * math.log(5))
        assert mixing.choose_exponent(totals, 1e6, target, None) == pytest.approx(want, abs=2e-5)
    for most in (2.0, 4.0):
        want = min(a for a in grid if passes(a) <= most)
        assert mixing.choose_exponent(totals, 1e6, None, most) == pytest.approx(want, abs=2e-5)


def test_label_model_equals_a_plain_expectation_step():
    """The posterior is Bayes' rule over the fitted tables, voter by voter."""
    rng = np.random.default_rng(3)
    votes = rng.integers(0, 3, (50, 4))
    model = toxicity.LabelModel(votes, np.ones(50))
    for v, got in zip(votes, model.posterior(votes)):
        odds = []
        for c, share in ((0, 1 - model.prior), (1, model.prior)):
            p = share
            for i, j in enumerate(model.parent):
                p *= model.single[c, i, v[i]] if j < 0 else model.given[c, i, j, v[i], v[j]]
            odds.append(p)
        assert got == pytest.approx(odds[1] / sum(odds), abs=1e-9)


def test_pipeline_equals_its_parts(spark, sf):
    """All stages but the classifier against brute force on the rows that each of them gets."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150)
    scratch, frames = Scratch(spark), [docs]
    for _, stage in P.STAGES:
        frames.append(scratch.write(stage(spark, frames[-1], sf), "stage"))
    rows = [sorted((r.doc_id, r.text) for r in f.select("doc_id", "text").collect()) for f in frames[:5]]
    quality = {r.doc_id: r.score for r in QualityClassifier().fit(docs, spark.read.parquet(f"{sf}/labels.parquet")).score(docs).collect()}
    assert [d for d, _ in rows[1]] == [d for d, _ in rows[0] if quality[d] >= P.REJECT_BELOW]
    assert [d for d, _ in rows[2]] == [d for d, _, c in naive_components(rows[1]) if c == d]
    split = {d: t.split() for d, t in rows[2]}
    first, cut = {}, {}
    for d, w in sorted(split.items()):
        again = {j for i in range(len(w) - 49) if first.setdefault(tuple(w[i : i + 50]), d) < d for j in range(i, i + 50)}
        cut[d] = len(w), len(again)
    assert [d for d, _ in rows[3]] == [d for d, _ in rows[2] if not cut[d][1] or cut[d][1] < cut[d][0]]
    assert all(len(t.split()) == cut[d][0] - cut[d][1] for d, t in rows[3])
    words_of = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w]
    windows = set()
    for item in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words_of(item.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1))} if w else set()
    sizes = {len(x) for x in windows}
    leaks = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    assert [d for d, _ in rows[4]] == [d for d, t in rows[3] if not leaks(words_of(t))]
    mixed = frames[5].toPandas()
    tokens = {d: len(t.split()) for d, t in rows[4]}
    assert set(mixed.doc_id) <= set(tokens) and all(n == tokens[d] for d, n in zip(mixed.doc_id, mixed.n_tokens)) and not mixed.duplicated(["doc_id", "epoch"]).any()


def test_running_sums_over_many_tasks(spark):
    rng = random.Random(7)
    rows = [(rng.choice([-5, 1, 9]), i, rng.randrange(10)) for i in range(3000)]
    got = mixing.running(spark.createDataFrame(rows, "g long, k long, size long").repartition(5), "g", ["k"], "size", Scratch(spark)).collect()
    want, total, n = {}, {}, {}
    for g, k, size in rows:
        n[g] = n.get(g, 0) + 1
        want[k] = (n[g], total.get(g, 0))
        total[g] = total.get(g, 0) + size
    assert {r.k: (r["rank"], r.before) for r in got} == want


def test_mixing_goes_past_a_long_document(spark):
    rows = [(i, "w " * (400 if i % 50 == 3 else 5), "a" if i < 200 else "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in range(1, 4):
        out = mixing.mix_sources(docs, budget_tokens=1000, target_entropy=None, max_repeats=None, seed=seed).toPandas()
        got = out.groupby("source").n_tokens.sum()
        assert ((got > 495) & (got <= 500)).all() and len(got) == 2


def test_revisit_without_time(spark):
    kind = "record_id long, kind string, url string, ts double, etag string, last_modified string, digest string, headers map<string,string>"
    rows = [
        (1, "response", "http://a/x", 1.0, "e", None, None, None), (2, "response", "http://a/x", 9000.0, "f", None, None, None),
        (3, "response", "http://a/x", None, "g", None, None, None), (4, "revisit", "http://a/x", None, "f", None, None, None),
        (5, "revisit", "http://a/y", None, "f", None, None, None), (6, "revisit", None, None, "f", None, None, None),
        (7, "revisit", "http://a/x", 2.0, "e", None, None, None), (8, "revisit", "http://a/x", None, "e", None, None, None),
    ]
    got = {r.record_id: (r.original_id, r.verdict) for r in revisit.resolve_revisits(spark.createDataFrame(rows, kind)).collect()}
    assert got == {4: (2, "resolved"), 5: (None, "no_original"), 6: (None, "no_original"), 7: (1, "resolved"), 8: (None, "validator_mismatch")}


def test_mixing(spark, edge_docs, no_docs):
    rows = [(i, "w " * (1 + i % 7), "big" if i < 600 else "mid" if i < 780 else "small") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(docs, target_entropy=0.9, max_repeats=None, block_docs=16).toPandas()
    total = sum(1 + i % 7 for i in range(800))
    for s, g in out.groupby("source"):
        budget = math.floor(g.weight.iloc[0] * total)
        assert budget - 7 <= g.n_tokens.sum() <= budget
        assert g.groupby("doc_id").epoch.nunique().max() <= 12 and not g.duplicated(["doc_id", "epoch"]).any()
    p = np.array([0.75, 0.225, 0.025])
    w = out.groupby("source").weight.first().to_numpy()
    assert -(w * np.log(w)).sum() >= 0.9 * np.log(3) - 0.01 and w.sum() == pytest.approx(1, abs=1e-6)
    assert p[0] > w[0]
    limited = mixing.mix_sources(docs, target_entropy=0.9, max_repeats=2.0).groupBy("source").agg(F.first("weight").alias("w")).toPandas()
    assert (limited.sort_values("source").w / np.array([sum(1 + i % 7 for i in r) / total for r in (range(600), range(600, 780), range(780, 800))])).max() <= 2.001
    assert mixing.mix_sources(edge_docs).count() > 0  # which documents fit depends on the budgets
    assert mixing.mix_sources(no_docs).count() == 0


def test_revisits(spark):
    schema = "record_id long, kind string, url string, ts double, etag string, last_modified string, digest string, headers map<string,string>"
    rows = [
        (1, "response", "http://www.A.com:80/x/?b=2&a=1#f", 0.0, '"e1"', None, "d1", {"ETag": '"e1"', "Content-Length": "9", "Date": "old"}),
        (2, "response", "https://a.com/x?a=1&b=2&utm_source=q", 9000.0, '"e2"', None, "d2", None),
        (3, "revisit", "http://a.com/x?a=1&b=2", 5000.0, 'W/"e1"', None, None, {"date": "new", "Content-Length": "0"}),
        (4, "revisit", "http://a.com/x?a=1&b=2", 20000.0, '"e1"', None, None, None),
        (5, "revisit", "http://a.com/y", 20000.0, None, None, None, None),
        (6, "revisit", None, 1.0, None, None, None, None),
        (7, "revisit", "http://a.com/x?b=2&a=1", 9000.0, None, None, None, {"Vary": "x"}),
        (7, "revisit", "http://a.com/x?b=2&a=1", 9000.0, None, None, None, {"Vary": "x"}),
    ]
    got = {r.record_id: r for r in revisit.resolve_revisits(spark.createDataFrame(rows, schema)).collect()}
    assert (got[3].original_id, got[3].verdict, got[3].headers) == (1, "resolved", {"etag": '"e1"', "content-length": "9", "date": "new"})
    assert (got[4].original_id, got[4].verdict) == (None, "validator_mismatch")
    assert got[5].verdict == got[6].verdict == "no_original"
    assert (got[7].original_id, got[7].verdict, got[7].headers["vary"]) == (1, "unvalidated", "x")
    assert revisit.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_pipeline_stages_pass_any_columns_on(spark, sf, edge_docs, no_docs):
    """Columns with the names of the operators' own, a map among them; nulls, repeated rows, rows that share a doc_id; no rows."""
    import corpus_pipeline as P

    names = ["digest", "first", "low", "high", "copy", "kept", "n_words", "row_key", "row", "cut", "key", "l", "node"]
    wide = edge_docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat_ws("-", F.lit(c), "doc_id").alias(c) for c in names])
    wide = wide.withColumn("m", F.create_map(F.lit("k"), "doc_id")).unionByName(wide.where("doc_id = 3").withColumn("text", F.lit("quite another text")).withColumn("m", F.create_map(F.lit("k"), F.lit(0).cast("long"))))
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, wide, sf)
        assert got.columns == wide.columns, name
        rows = got.collect()
        assert len(rows) > 0 and all(r[c] == "-".join([c] + [str(r.doc_id)] * (r.doc_id is not None)) for r in rows for c in names), name
        empty = stage(spark, wide.limit(0), sf)
        assert empty.columns == wide.columns and empty.count() == 0
    assert P.STAGES[-1][1](spark, wide, sf).count() > 0 and P.STAGES[-1][1](spark, no_docs, sf).count() == 0
    near = P.STAGES[1][1](spark, wide, sf).collect()
    texts = [r.text for r in near if r.doc_id is not None]
    assert texts.count("quite another text") == 1 and len(near) - len(texts) == 2  # null ids stay
    groups = {r.doc_id: r.component_id for r in ngram_join.ngram_components(edge_docs).where("doc_id is not null").collect()}
    assert len(texts) == len(set(groups.values())) + 1


def test_rows_without_doc_id_or_kind(spark, sf, edge_docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for f in (score_quality, toxicity.score_toxicity):
        assert f(edge_docs, labels).where("held_out is null").count() == 0
    kind = "record_id long, kind string, url string, ts double, etag string, last_modified string, digest string, headers map<string,string>"
    rows = [(i, k, "http://a/x", float(i), "e", None, None, None) for i, k in enumerate(["response", "request", "metadata", None, "revisit"])]
    assert [(r.record_id, r.original_id) for r in revisit.resolve_revisits(spark.createDataFrame(rows, kind)).collect()] == [(4, 0)]
    same = spark.range(3000).selectExpr("cast(null AS long) AS doc_id", "'a b c' AS text", "'s' AS source")
    blocks = mixing.mix_sources(same, block_docs=100).groupBy("block").count().toPandas()
    assert blocks["count"].sum() == 3000 and len(blocks) > 20 and blocks["count"].max() < 500


def test_label_samples_are_bounded_in_rows(spark):
    from tessera.llm.quality import labelled_sample

    docs = spark.createDataFrame([(i % 4, f"t{i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4)], "doc_id long, quality int, toxic int")
    assert labelled_sample(docs, labels, "quality", 3, 4, 9).count() == 3


def test_texts_longer_than_a_piece(spark):
    """Two texts of 1.3 MB beside short ones, in every operator that reads texts in pieces."""
    import public_tokenizers

    rng = random.Random(12)
    long = " ".join(f"{rng.choice('abcdefg')}{rng.randrange(40000)}" for _ in range(200_000))
    passage = " ".join(f"p{i}" for i in range(120))
    rows = [(1, long, "x"), (2, passage + " end", "x"), (3, long[:700_000] + " " + passage + " " + long[700_000:], "x"), (4, "short", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    path = public_tokenizers.path("word_bpe_49k.json")
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs, path).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == tokencount.naive_token_counts([t for _, t, _ in rows], path)
    comps = {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs).collect()}
    assert comps == {1: 1, 2: 2, 3: 1, 4: 4}
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in substring.dedup_substrings(docs).collect()}
    n = len(rows[2][1].split())
    assert cut[1] == (200_000, 0) and cut[2] == (121, 0) and cut[3][0] == n and cut[3][1] >= n - 2
    gone = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix.dedup_bytes(docs).collect()}
    assert gone[1] == (len(long), len(long)) and gone[2][1] >= len(passage) and gone[3][0] == len(rows[2][1]) and gone[4] == (5, 0)
    kept = {r.doc_id: r.n_words for r in rules.quality_rules(docs).collect()}
    assert kept[1] == 200_000 and kept[4] == 1
    for f, label in ((score_quality, "quality"), (toxicity.score_toxicity, "toxic")):
        assert f(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 4


def test_pipeline_stages(spark, sf, no_docs):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scratch = Scratch(spark)
    frames = [docs]
    for name, stage in P.STAGES:
        frames.append(scratch.write(stage(spark, frames[-1], sf), "stage"))
    for f in frames[1:-1]:
        assert f.columns == docs.columns
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    comps = ngram_join.ngram_components(frames[1]).toPandas()
    assert ids[2] == set(comps.component_id)
    left = pd.DataFrame([(r.doc_id, r.text) for r in frames[3].collect()], columns=["doc_id", "text"])
    assert sum(x[1] for x in naive_substring(list(left.itertuples(index=False)))) <= 200
    assert D.decontaminate(frames[4], spark.read.parquet(f"{sf}/benchmark.parquet"))[0].where("contaminated").count() == 0
    assert frames[5].where(F.col("doc_id").isNull()).count() == 0
