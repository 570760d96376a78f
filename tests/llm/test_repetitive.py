"""Decontamination of repetitive texts: linear, and equal to brute force."""

import random
import time

from tessera.llm.decontaminate import decontaminate


def brute(text, items):
    words = text.split()
    hit, named = set(), set()
    for i, item in items:
        w = item.split()
        m = min(10, len(w))
        windows = {tuple(w[s : s + m]) for s in range(len(w) - m + 1)}
        for p in range(len(words) - m + 1):
            if tuple(words[p : p + m]) in windows:
                hit |= set(range(p, p + m))
                named.add(i)
    return len(words), len(hit), len(named)


def test_repetitive_text(spark):
    """8,000 equal words against an item of 1,200 of them, and periodic texts; under 20 s."""
    docs = spark.createDataFrame([(1, "ha " * 8000), (2, "ha ho " * 3000), (3, "clean words only " * 2000), (4, "x " * 9 + "ha " * 9)], "doc_id long, text string")
    items = spark.createDataFrame([("a", "ha " * 1200), ("b", "ho ha " * 500), ("c", "ho " * 400)], "item_id string, text string")
    decontaminate(docs.limit(1), items)[0].count()  # the session is warm
    began = time.time()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate(docs, items)[0].collect()}
    assert time.time() - began < 20
    assert got == {1: (8000, 8000, 1), 2: (6000, 6000, 1), 3: (6000, 0, 0), 4: (18, 0, 0)}


def test_random_periodic_texts(spark):
    rng = random.Random(7)
    make = lambda n: " ".join(w for _ in range(n) for w in [rng.choice("ab")] * rng.choice([1, 2, 9, 10, 11]))
    items = [(f"i{k}", make(rng.randrange(1, 8))) for k in range(25)] + [("s1", "a"), ("s2", "b a b"), ("i0", "ignored not")]
    items = list(dict(reversed(items)).items())
    docs = [(k, make(rng.randrange(1, 25))) for k in range(60)]
    verdicts, hits = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in verdicts.collect()}
    assert got == {k: brute(text, items) for k, text in docs}
    assert {r.doc_id for r in hits.select("doc_id").distinct().collect()} == {k for k, v in got.items() if v[1]}
