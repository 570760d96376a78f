"""Personal data against the patterns that define the base kinds, and spans that anchors add."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        total = sum((d if i % 2 == 0 else d * 2 - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(digits))))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def row_of(text):
    base = brute(text)
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
    return (*[sum(k == x[0] for x in base) for k in PATTERNS], hashlib.sha256(joined.encode()).hexdigest())


def test_base_spans_of_random_texts():
    rng = random.Random(1)
    parts = ["@", ".", "..", "+", " ", "-", "(", ")", "\n", "0", "1", "25", "255", "256", "4111111111111111", "4111 1111-1111 1111", "a", "b.c", "%", "é", "x@y.z", "10.0.0.1", "+49 30 1234567", "tel:", "IBAN ", "://", "_"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        base, added = pii.find_spans(text)
        assert base == brute(text), text
        spans = sorted((a, b) for _, a, b in added)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert not any(a < d and c < b for _, a, b in added for _, c, d in base)


def test_query_equals_patterns(spark, sf):
    want = {r["doc_id"]: row_of(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op12_personal_data"](spark, sf).collect()
    assert {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got} == want
    assert len(got) == len(want) and sum(sum(w[:4]) for w in want.values()) > 5


def test_edge_rows(spark, tmp_path):
    """Null, empty, long and repeated texts, a null doc_id, columns that clash with those of the result; no rows."""
    texts = [None, "", "x" * 200_000, "1" * 100_000, "1." * 50_000, "a@" * 50_000, "+1 " * 30_000, "a@b.de", "a@b.de", "é 10.0.0.7 ü@b.de"]
    schema = "doc_id long, text string, base string, added long, spans string"
    rows = [(i if i else None, t, "b", 1, "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_personal_data"](spark, str(tmp_path)).collect()}
    assert time.time() - began < 60  # linear in the longest texts
    assert len(got) == len(texts)
    assert [got[k]["n_email"] for k in (7, 8, 9)] == [1, 1, 0] and got[9]["n_ip"] == 1 and got[None]["spans"] == got[1]["spans"] == ""
    assert got[9]["spans"] == "email:11:17,ip:2:10"
    assert got[7]["base_sha256"] == hashlib.sha256(b"email:0:6").hexdigest()
    assert got[4]["n_ip"] == 12_500
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.QUERIES["op12_personal_data"](spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ("Write to josé@müller.de now", [("email", "josé@müller.de")]),
        ("ann(at)mail.example.com!", [("email", "ann(at)mail.example.com")]),
        ("IBAN: DE89 3704 0044 0532 0130 00 thanks", [("account", "DE89 3704 0044 0532 0130 00")]),
        ("IBAN: DE88 3704 0044 0532 0130 00 thanks", []),
        ("Konto 12345678.", [("account", "12345678")]),
        ("account no. AB123456C and", [("account", "AB123456C")]),
        ("accountant 12345678", []),
        ("see ftp://ann:pw@host/x", [("login", "ann:pw")]),
        ("http://host/a@b", []),
        ("Fax 030 1234 567 or", [("phone", "030 1234 567")]),
        ("phone 12", []),
        ("a b c 1 2 3 token at home", []),
    ],
)
def test_added_spans(text, want):
    assert [(k, text[a:b]) for k, a, b in pii.find_spans(text)[1]] == want


def test_clean_documents_have_no_added_spans(spark, sf):
    """On the given documents anchors add nothing: all their personal data is of the base kinds."""
    found = pii.find_personal_data(spark.read.parquet(f"{sf}/documents.parquet"))
    assert found.where(F.size("added") > 0).count() == 0
