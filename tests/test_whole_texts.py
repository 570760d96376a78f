"""Queries over whole texts, against Python on a fixture whose texts differ after any prefix."""

import re
import string

import pytest

from tessera import catalog

TEXTS = {
    1: "The start of a text that goes on for more than forty characters\nand ends in 17 and -2.5e3 An É.",
    2: "x" * 60 + "\nAnswer: late [note] value ```python\nprint(1)",
    3: "12345.5",
    4: "les",
    5: "Über\tthe\n\nöde a an Éa the.",
    6: "",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, x, "en", len(x)) for i, x in TEXTS.items()], "doc_id long, text string, lang string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


NO_MARKS = dict.fromkeys(map(ord, string.punctuation))


def normalize(s):
    """Lower case without punctuation; words but articles, one space apart."""
    return " ".join(w for w in re.split(r"\b(?:a|an|the)\b|\s+", s.lower().translate(NO_MARKS)) if w)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def number(s):
    try:
        return float(s)
    except ValueError:
        return None


EXPECTED = {
    "f1_first_answer": lambda x, d: x,
    "f2_last_answer": lambda x, d: f"en{d}",
    "f9_minerva": lambda x, d: (re.findall(r"(?i)Answer\s*:\s*([^\n]+)", "Answer: " + x) or ["[INVALID]"])[-1].strip(" "),
    "f15_numbers": lambda x, d: ",".join(re.findall(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?", f"{x} {d} {x} en{d}")),
    "f18_code_block": lambda x, d: ("a```python" + x + "```b").split("```python")[-1].split("```")[0],
    "f24_think": lambda x, d: x,
    "f30_normalize": lambda x, d: normalize(x),
    "f34_strip_dot": lambda x, d: x.strip(" ").removesuffix(".").strip(" "),
    "f42_closest_choice": lambda x, d: min(("the", "und", "les", "que"), key=lambda c: distance(x, c)),
    "f83_parse_or_null": lambda x, d: number(x),
    "f85_template": lambda x, d: f"Q: {x} ({d})",
}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_whole_text(spark, folder, name):
    got = {r.doc_id: r.value for r in catalog.QUERIES[name](spark, folder).collect()}
    assert got == {d: EXPECTED[name](x, d) for d, x in TEXTS.items()}


def test_whole_prompt(spark, folder):
    assert {r.doc_id: r.prompt for r in catalog.QUERIES["f86_row_construction"](spark, folder).collect()} == TEXTS
