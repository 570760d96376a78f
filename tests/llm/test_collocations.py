"""Collocations against brute force, with bitmaps that let nearly everything through and others that do not."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import collocations as C
from tessera.llm import queries


def brute(rows, longest=3, least=10, percent=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        held = set()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    if 100 * a >= percent * counts[p[i : i + size]]:
                        held.add(p[i : i + size])
        rows = []
        for p, a in candidates.items():
            if p not in held:
                score, cut = min((10**6 * a * a // (counts[p[:c]] * counts[p[c:]]), c) for c in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -score) for i, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty texts, ties, repeated rows, capitals, several separators, a long text, clashing columns, skewed words."""
    rng = random.Random(3)
    vocabulary = ["a", "the", "Of", "new", "york", "city", "é", "ÉA", "x-y", "z'"] + [f"w{i}" for i in range(60)]
    text = lambda n: "".join(rng.choice(vocabulary[: rng.choice([3, 8, 70])]) + rng.choice([" "] * 8 + ["  ", "\t", ". ", ",", "\n", " ! ", "\r\n", "\x0b"]) for _ in range(n))
    rows = [(i, text(rng.randrange(200)), rng.choice(["en", "de", "und", None]), 1, 2, "p") for i in range(150)]
    rows += [(500, None, "en", 1, 2, "p"), (501, "", None, 1, 2, "p"), (None, "new york city " * 2000, "en", 1, 2, "p"), (502, " \t ", "fr", 1, 2, "p"), rows[0], rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n long, hash long, phrase string").repartition(5).cache()


@pytest.mark.parametrize("bits, longest, least", [(26, 3, 10), (4, 3, 10), (18, 4, 3), (26, 2, 300)])
def test_equals_brute_force(docs, bits, longest, least):
    want = brute([(r["lang"], r["text"]) for r in docs.collect()], longest, least)
    assert rows_of(C.collocations(docs, longest, least, bucket_bits=bits)) == want
    assert want


def test_top(docs):
    """Only the first phrases of each language."""
    want = brute([(r["lang"], r["text"]) for r in docs.collect()], top=7)
    assert rows_of(C.collocations(docs, top=7)) == want and max(r[1] for r in want) == 7


def test_buckets_prune(docs):
    """Few phrases that are not frequent are counted at all."""
    tests = None
    enough, bits, sizes = 10, 26, []
    for k in (1, 2):
        counted = C._counted(docs, k, 3, tests, enough, bits)
        exact = counted.where("phrase is not null").groupBy("lang", "phrase").agg({"n": "sum", "hash": "min"}).toDF("lang", "phrase", "f", "hash")
        sizes.append((exact.count(), exact.where("f >= 10").count()))
        tests = C.bitmap(C._hash_rows(exact.where("f >= 10"), bits), bits, 1), C.bitmap(counted.where("range is not null").select("range", "at", "counts"), bits, enough)
    assert sizes[1][0] <= sizes[1][1] * 1.02 + 2


def test_no_rows(spark, docs):
    assert C.collocations(docs.limit(0)).count() == 0


def test_products_beyond_64_bits(spark, monkeypatch):
    counts = spark.createDataFrame([("en", "a", 1, 9 * 10**12), ("en", "b", 1, 8 * 10**12), ("en", "a b", 2, 7 * 10**12)], "lang string, phrase string, k int, f long")
    monkeypatch.setattr(C, "phrase_counts", lambda docs, *_: (counts, spark.createDataFrame([("en", 10**14)], "lang string, n long")))
    assert rows_of(C.collocations(counts)) == [("en", 1, "a b", 7 * 10**12, 9 * 10**12, 8 * 10**12, 10**14, 10**6 * 49 // 72)]


def test_query_equals_brute_force(spark, sf):
    want = brute([(r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert rows_of(queries.QUERIES["op13_collocations"](spark, sf)) == want
