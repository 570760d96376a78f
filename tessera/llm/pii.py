"""Personal data found by expanding anchors.

One Aho-Corasick automaton reads each text once and reports at-signs, plus signs,
schemes (``://``, ``mailto:`` and others) and identifier cues (``IBAN``, ``account`` and
others).  A small deterministic parser for each kind of anchor then walks left and right
from it, over the characters that its kind allows, and validates what it has: domain
labels, digit counts, address parts, check digits.  Digit runs, which need no cue, are
the anchors of addresses and cards.  Every parser is linear in the text.

Base kinds are those that a pattern states (leftmost, non-overlapping, failing matches
dropped): ``email``, ``ip``, ``card``, ``phone``.  Beyond them the anchors add

* ``email``: addresses with letters outside ASCII in the local part or the domain, and
  written-out at-signs (``(at)``, ``[at]``) before a domain;
* ``phone``: numbers after ``tel:``, ``phone`` or ``fax`` without a plus sign;
* ``account``: international bank account numbers whose check digits hold, and numbers of
  6 to 20 digits and letters right after an account, passport or tax cue;
* ``login``: user information of a URL (``scheme://user:word@host``).

An added span never overlaps a base span or an earlier added one.

Defined results: null text is empty and has no spans; texts are read whole, whatever
their length; repeated rows each get their row; other columns are ignored; no rows give
no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import scratch as S

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans that only anchors find, after the base kinds.
FURTHER = ("account", "login")

SCHEMES = ("://", "mailto:", "tel:")
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "kontonummer", "cuenta", "compte", "passport", "ssn", "tax id", "steuernummer")
PHONE_CUES = ("phone", "telefon", "teléfono", "téléphone", "fax", "mobile")
WRITTEN_AT = ("(at)", "[at]", "{at}")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_DIGITS = frozenset("0123456789")

_ADDRESS = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]++")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_WIDE_DOMAIN = re.compile(r"[^\W_](?:[\w-]*+)(?:\.[^\W_][\w-]*+)++")
_NUMBER = re.compile(r"[ :=#.\t]{1,4}(?:(?:no|nr|number|num)\b[ :=#.\t]{0,4})?([A-Z]{0,3}[0-9][A-Z0-9-]{4,18}[A-Z0-9])(?![A-Za-z0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_DIALLED = re.compile(r"[ :=.\t]{0,4}([0-9(][ ().0-9/-]++)")
_USER = re.compile(r"[^\s/@:?#]{1,64}(?::[^\s/@]{1,64})?@")


@cache
def automaton():
    """Anchors by what they are: each cue in lower, upper and title case, so that texts keep their code points."""
    import ahocorasick

    out = ahocorasick.Automaton()
    cues = [("@", "at"), ("+", "plus")]
    cues += [(x, "scheme") for x in SCHEMES] + [(x, "account") for x in ACCOUNT_CUES] + [(x, "dial") for x in PHONE_CUES + ("tel:",)] + [(x, "written") for x in WRITTEN_AT]
    for word, kind in cues:
        for form in {word, word.upper(), word.title()}:
            out.add_word(form, (kind, len(form)))
    out.make_automaton()
    return out


def _run_left(text: str, end: int, least: int, allowed: frozenset) -> int:
    while end > least and text[end - 1] in allowed:
        end -= 1
    return end


def luhn(digits: str) -> bool:
    """Whether the check digit holds: every second digit from the right doubled, its digits summed."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def iban(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str, ats: list[int]) -> list[tuple[int, int]]:
    """From each at-sign left over a local part, no further than the last address, and right over two labels or more."""
    out, least = [], 0
    for at in ats:
        start = _run_left(text, at, least, _LOCAL)
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            least = m.end()
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    small = lambda part: len(part := part.lstrip("0")) < 4 and int(part or 0) < 256
    return [m.span() for m in _ADDRESS.finditer(text) if all(map(small, m.groups()))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CHAIN.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str, pluses: list[int]) -> list[tuple[int, int]]:
    out = []
    for at in pluses:
        if m := _PHONE.match(text, at):
            found = m.group().rstrip(" ().-")
            if len(found) >= 4 and 9 <= sum(c in _DIGITS for c in found) <= 15:
                out.append((at, at + len(found)))
    return out


def _more_emails(text: str, ats: list[int], written: list[tuple[int, int]]):
    """With letters of any alphabet around an at-sign, or around a written one."""
    for start, end in [(at, at + 1) for at in ats] + written:
        left = start
        while left and start - left < 64 and (text[left - 1].isalnum() or text[left - 1] in "._%+-"):
            left -= 1
        if left < start and text[left].isalnum() and (m := _WIDE_DOMAIN.match(text, end)):
            yield "email", left, m.end()


def _accounts(text: str, ends: list[int]):
    for end in ends:
        if m := _IBAN.search(text, end, end + 60):
            found = m.group()
            for stop in range(len(found), 14, -1):  # the longest number whose check digits hold
                number = found[:stop].replace(" ", "")
                if found[stop - 1] != " " and 15 <= len(number) <= 34 and iban(number):
                    yield "account", m.start(), m.start() + stop
                    break
        if (m := _NUMBER.match(text, end)) and sum(c in _DIGITS for c in m.group(1)) >= 6:
            yield "account", *m.span(1)


def _dialled(text: str, ends: list[int]):
    for end in ends:
        if m := _DIALLED.match(text, end):
            found = m.group(1).rstrip(" ().-/")
            if 7 <= sum(c in _DIGITS for c in found) <= 15:
                yield "phone", m.start(1), m.start(1) + len(found)


def _logins(text: str, ends: list[int]):
    for end in ends:
        if m := _USER.match(text, end):
            yield "login", m.start(), m.end() - 1


def find_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans) of (kind, start, end) in code points, each by kind as listed, then start."""
    anchors: dict[str, list] = {k: [] for k in ("at", "plus", "scheme", "account", "dial", "written")}
    for last, (kind, size) in automaton().iter(text):
        anchors[kind].append((last + 1 - size, last + 1))
    ats = [a for a, _ in anchors["at"]]
    base = [("email", *x) for x in emails(text, ats)]
    base += [("ip", *x) for x in addresses(text)] + [("card", *x) for x in cards(text)] + [("phone", *x) for x in phones(text, [a for a, _ in anchors["plus"]])]
    ends = lambda kind: [b for _, b in anchors[kind]]
    more = [*_more_emails(text, ats, anchors["written"]), *_accounts(text, ends("account")), *_dialled(text, ends("dial")), *_logins(text, ends("scheme"))]
    taken: list[tuple[int, int]] = []  # disjoint and sorted
    for _, start, end in sorted(base, key=lambda x: x[1]):
        if taken and start < taken[-1][1]:
            taken[-1] = taken[-1][0], max(end, taken[-1][1])
        else:
            taken.append((start, end))
    added = []
    for kind, start, end in sorted(set(more), key=lambda x: (x[1], -x[2], x[0])):
        at = bisect_left(taken, (end, 0))
        if not at or taken[at - 1][1] <= start:
            taken.insert(at, (start, end))
            added.append((kind, start, end))
    order = {k: i for i, k in enumerate(KINDS + FURTHER)}
    return base, sorted(added, key=lambda x: (order[x[0]], x[1]))


SPAN = "array<struct<kind: string, start: int, end: int>>"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """For each document: doc_id, its ``base`` spans and the spans ``added`` by anchors (kind, start, end)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {SPAN}, added {SPAN}")
    arrow = to_arrow_schema(schema)

    def run(rows):
        out = []
        for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1)):
            base, added = find_spans(text.as_py() or "")
            out.append({"doc_id": doc_id} | {k: [dict(zip(("kind", "start", "end"), s)) for s in spans] for k, spans in (("base", base), ("added", added))})
        yield S.pa.RecordBatch.from_pylist(out, schema=arrow)

    return S.arrow_map(S.texts_of(docs), run, schema)


def joined_spans(spans: Column) -> Column:
    """kind:start:end, by kind as listed, then start, comma-joined."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS + FURTHER)), x["kind"])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(rank(x).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

