"""Multiple-choice, open-answer and tagged-answer parsers as Spark columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import PUNCTUATION, blank_to_null, count_of, format_ok, interval_iou, interval_recall, last, let, normalize_answer  # noqa: F401

# Characters stripped from choice replies, in this order.
STRIPPED = [",", ".", "!", "?", ";", ":", "'"]
# Phrases that announce a choice.
PHRASES = [
    "the answer is", "answer is", "the correct answer is", "correct answer is", "the answer", "answer", "correct answer", "the correct answer",
    "the best answer is", "best answer is", "the best answer", "best answer", "the option is", "option is", "the correct option is", "correct option is",
    "the choice is", "choice is", "the correct choice is", "correct choice is", "i choose", "i select", "i pick", "my answer is", "my choice is",
]
# What stands before a letter answer; the last two are one string each.
PREFIXES = ["The best answer is", "The correct answer is", "The answer is", "The answer", "The best option isThe correct option is", "Best answer:Best option:"]
# Words before the part of an open answer that counts.
INDICATORS = ["could be ", "so ", "is ", "thus ", "therefore ", "final ", "answer ", "result "]


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(x, F.lit(" \t\n\x0b\f\r"))


def rfind(x: Column, needle: Column) -> Column:
    """0-based place of the last ``needle``, -1 if none."""
    return F.when(F.contains(x, needle), F.length(x) - F.length(needle) - F.length(F.call_function("substring_index", x, needle, F.lit(-1)))).otherwise(-1)


def find(x: Column, needle: Column, start: Column | None = None) -> Column:
    """0-based place of the first ``needle`` from ``start`` on, -1 if none."""
    return (F.position(needle, x) if start is None else F.position(needle, x, start + 1)) - 1


def _choice(x: Column, marks: Sequence[str] = STRIPPED) -> Column:
    for c in marks:
        x = F.btrim(x, F.lit(c))
    return F.concat(F.lit(" "), x, F.lit(" "))


def parse_choice(x: Column, choices: str = "ABCDEFGH") -> Column:
    """Letter of a free-form reply by the best ranked of twelve patterns; of equals the earliest place, then the first found."""
    r = _choice(strip(x), [*STRIPPED, '"'])
    bare, letters = strip(r), F.array(*map(F.lit, choices))
    none = F.lit(-1)

    def ranked(rank: int, group: int, place) -> Column:
        """(rank, -place, -found, letter) for each letter that has a place."""
        found = F.transform(letters, lambda c, i: F.struct(F.lit(rank).alias("rank"), (-place(c, i)).alias("early"), (-(i + 100 * group)).alias("order"), c.alias("letter")))
        return F.filter(found, lambda s: s["early"] <= 0)

    def after(left: str, right: str):
        return lambda c, i: rfind(r, F.concat(F.lit(left), c, F.lit(right)))

    phrases = F.filter(F.transform(F.array(*map(F.lit, PHRASES)), lambda p, k: F.struct(find(F.lower(r), p).alias("at"), k.alias("k"))), lambda s: s["at"] >= 0)
    said = F.flatten(F.transform(phrases, lambda p: F.transform(letters, lambda c, i: F.struct(F.lit(7).alias("rank"), (-find(r, c, p["at"])).alias("early"), (-(i + 100 * (20 + p["k"]))).alias("order"), c.alias("letter")))))
    found = F.concat(
        ranked(6, 1, after("(", ")")), ranked(5, 2, after("", ".")), ranked(4, 3, after("", ":")), ranked(3, 4, after("", ")")), ranked(2, 5, after("", " ")),
        ranked(1, 6, after("", "-")), ranked(1, 7, after("", "_")), ranked(1, 8, after("", "=")), F.filter(said, lambda s: s["early"] <= 0),
        ranked(10, 60, lambda c, i: F.when(F.startswith(bare, c), F.lit(0)).otherwise(none)),
        ranked(9, 61, lambda c, i: F.when(F.endswith(bare, c), F.length(r) - 1).otherwise(none)),
        ranked(8, 62, lambda c, i: rfind(r, F.concat((i + 1).cast("string"), F.lit(". "), c))),
    )
    found = F.when(F.size(found) > 0, found).otherwise(ranked(0, 63, lambda c, i: rfind(r, c)))
    return F.coalesce(F.array_max(found)["letter"], F.lit(""))


def _last_of(candidates: Column, place) -> Column:
    """The candidate with the largest place, the first of equals; the only one wherever it stands."""
    at = F.transform(candidates, lambda c, i: F.struct(place(c).alias("at"), (-i).alias("order"), c.alias("c")))
    return F.array_max(at)["c"]


def _by_content(r: Column, letters: Column, texts: Column) -> Column:
    """Letter of the option whose text stands last in a reply of more than five words, or null."""
    spoken = F.size(F.split(strip(r), r"\s+")) > 5
    held = lambda low: F.filter(F.arrays_zip(letters.alias("letter"), texts.alias("text")), lambda p: F.contains(low, F.lower(p["text"])))
    at = lambda low: F.transform(held(low), lambda p, i: F.struct(rfind(low, F.lower(p["text"])).alias("at"), (-i).alias("order"), p["letter"].alias("c")))
    return F.when(spoken, let(F.lower(r), lambda low: F.array_max(at(low))["c"]))


def parse_brackets(x: Column, letters: Column, texts: Column) -> Column:
    """Letter by (A), then "A ", then "A.", then an option's text in a reply of more than five words; the last of several.

    Where no pattern holds the result is null (a random letter has no defined value).
    """

    def read(r: Column) -> Column:
        mark = lambda left, right: F.filter(letters, lambda c: F.contains(r, F.concat(F.lit(left), c, F.lit(right))))
        at = lambda left, right: lambda c: rfind(r, F.concat(F.lit(left), c, F.lit(right)))
        pick = lambda found, place: let(found, lambda cs: _last_of(cs, place))
        bracket, spaced, dotted = pick(mark("(", ")"), at("(", ")")), pick(mark("", " "), at(" ", " ")), pick(mark("", "."), at(" ", " "))
        return F.coalesce(bracket, spaced, dotted, _by_content(r, letters, texts))

    return let(_choice(x), read)


def parse_periods(x: Column, letters: Column, texts: Column) -> Column:
    """As ``parse_brackets`` with "A." and "A:" first; "API Error" for empty replies, "No Answer Found." where nothing holds."""

    def read(r: Column) -> Column:
        mark = lambda left, right: F.filter(letters, lambda c: F.contains(r, F.concat(F.lit(left), c, F.lit(right))))
        at = lambda left, right: lambda c: rfind(r, F.concat(F.lit(left), c, F.lit(right)))
        dotted = let(mark("", "."), lambda found: F.when(F.size(found) > 0, let(F.concat(found, mark("", ":")), lambda both: F.when(F.size(both) == 1, both[0]).otherwise(_last_of(both, at("", "."))))))
        pick = lambda found, place: let(found, lambda cs: _last_of(cs, place))
        colon, bracket, spaced = pick(mark("", ":"), at("", ":")), pick(mark("(", ")"), at("(", ")")), pick(mark("", " "), at(" ", " "))
        return F.coalesce(dotted, colon, bracket, spaced, _by_content(r, letters, texts), F.lit("No Answer Found."))

    return F.when(x.isin("", "API Error"), F.lit("API Error")).otherwise(let(_choice(x), read))


def first_letter(x: Column) -> Column:
    """First of A-D after the announcing prefixes are gone, '' if none."""
    for p in PREFIXES:
        x = F.replace(strip(x) if p == PREFIXES[0] else x, F.lit(p), F.lit(""))
    return F.regexp_extract(x, "[ABCD]", 0)


def option_texts(x: Column) -> Column:
    """Texts of the options (A) to (D) of a question."""
    return F.transform(F.regexp_extract_all(x, F.lit(r"(?s)\([A-D]\)\s*(.+?)(?=\n\([A-D]\)|$)"), 1), strip)


def letter_list(x: Column, n: Column) -> Column:
    """The first n standalone capitals, '' where there are fewer."""
    found = F.slice(F.regexp_extract_all(x, F.lit(r"\b[A-Z]\b"), 0), F.lit(1), n)
    return F.concat(found, F.array_repeat(F.lit(""), n - F.size(found)))


def answer_values(x: Column) -> Column:
    """Normal forms of one answer as strings: a number to two places, or lower case (a single character with a space on either side)."""
    s = strip(x)
    plain = F.replace(s, F.lit(","), F.lit(""))
    number = F.when(plain.rlike(r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), F.round(plain.try_cast("double"), 2))
    low = F.lower(s)
    words = F.when(F.length(low) == 1, F.array(F.concat(F.lit(" "), low), F.concat(low, F.lit(" ")))).otherwise(F.array(low))
    return F.when(number.isNotNull(), F.array(F.concat(F.lit("#"), number.cast("string")))).otherwise(words)


def open_numbers(x: Column) -> Column:
    """Numbers with commas, in scientific notation, and plain ones."""
    every = lambda p: F.regexp_extract_all(x, F.lit(p), 0)
    return F.concat(every(r"-?\b\d{1,3}(?:,\d{3})+\b"), every(r"-?\d+(?:\.\d+)?[eE][+-]?\d+"), every(r"-?(?:\d+\.\d+|\.\d+|\d+\b)(?![eE][+-]?\d+)(?![,\d])"))


def parse_open(x: Column) -> Column:
    """Sorted distinct normal forms of what an open reply may answer; numbers are marked with #."""
    r = F.lower(F.btrim(strip(x), F.lit(".")))
    parts = F.split(r, r"\n")  # in lower case no sentence begins with a capital
    total = F.size(parts)

    def key(part: Column, i: Column) -> Column:
        tails = F.transform(F.array(*map(F.lit, INDICATORS)), lambda w, k: F.struct(w.alias("w"), k.alias("k")))
        tails = F.when(i == total - 1, F.concat(tails, F.array(F.struct(F.lit("=").alias("w"), F.lit(len(INDICATORS)).alias("k"))))).otherwise(tails)
        tails = F.filter(tails, lambda s: F.contains(part, s["w"]))
        cut = F.transform(tails, lambda s: F.struct(F.length(strip(_tail(part, s["w"]))).alias("n"), s["k"].alias("k"), strip(_tail(part, s["w"])).alias("t")))
        return F.array_min(F.filter(cut, lambda s: s["n"] > 0))["t"]

    keys = F.filter(F.transform(parts, key), lambda k: k.isNotNull() & ~k.isin(":", ",", ".", "!", "?", ";", "'"))
    keys = F.when(F.size(keys) > 0, keys).otherwise(F.array(r))
    every = F.concat(keys, F.flatten(F.transform(keys, open_numbers)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(every, answer_values))))


def _tail(x: Column, w: Column) -> Column:
    """What follows the last ``w``."""
    return F.right(x, F.length(x) - rfind(x, w) - F.length(w))


def match_open(golds: Column, values: Column) -> Column:
    """Whether a parsed open reply holds an answer: an equal number, or an answer's text inside one of its texts."""
    wanted = F.flatten(F.transform(golds, answer_values))
    is_number = lambda v: F.startswith(v, F.lit("#"))
    return F.exists(values, lambda v: F.when(is_number(v), F.array_contains(wanted, v)).otherwise(F.exists(wanted, lambda w: ~is_number(w) & F.contains(v, w))))


def match_choice(golds: Column, letter: Column) -> Column:
    return F.exists(golds, lambda g: g == letter)


def typed_answer(x: Column, kind: str, choices: Column | None = None, precision: int = 0) -> Column:
    """An extracted answer in its type: "multi_choice" (option letter or the most similar option), "integer", "float" or "list"."""
    if kind == "multi_choice":
        s = strip(x)
        letter = F.upper(blank_to_null(F.regexp_extract(s, r"\(([a-zA-Z])\)", 1)))
        s = F.coalesce(letter, s)
        index = F.when(s.rlike(r"\A[A-Z]\z"), F.ascii(s) - F.ascii(F.lit("A")))
        near = F.array_min(F.transform(choices, lambda c, i: F.struct(F.levenshtein(c, s).alias("d"), i.alias("i"), c.alias("c"))))["c"]
        return F.coalesce(F.get(choices, index), near)
    number = x.try_cast("double")
    if kind == "integer":
        return F.when(~F.isnan(number), number.cast("bigint").cast("string"))
    if kind == "float":
        return F.round(number, precision).cast("string")
    return x


def in_area(x: Column, area: Column) -> Column:
    """Whether a path or test file belongs to an area; "all" holds for each."""
    return (area == "all") | F.contains(x, F.concat(F.lit("/"), area, F.lit("/"))) | F.contains(x, F.concat(area, F.lit("_test.csv")))


def fallback_answer(x: Column, balanced: bool = False) -> Column:
    """First <answer>, else the last box, else the number that ends the last line which ends with one; '' if none."""
    from tessera.functions.text import last_boxed_balanced

    box = last_boxed_balanced(x) if balanced else last(F.regexp_extract_all(x, F.lit(r"\\boxed\{([^}]*)\}"), 1))
    number = r"\b(\d+(?:\.\d+)?)\b(?:\s*\.?\s*$)"
    line = last(F.filter(F.split(strip(x), "\n"), lambda v: v.rlike(number)))
    tag = r"(?s)<answer>(.*?)</answer>"
    return F.when(x.rlike(tag), F.regexp_extract(x, tag, 1)).otherwise(F.coalesce(blank_to_null(box), F.regexp_extract(line, number, 1), F.lit("")))


def graded_format(x: Column) -> Column:
    """1 for think and answer elements or a box; 0.8 for over 50 characters with a formula sign and an answer; else 0."""
    whole = x.rlike(r"(?s)\A<think>.*</think>.*<answer>.*</answer>\z")
    box = F.coalesce(last(F.regexp_extract_all(x, F.lit(r"\\boxed\{([^}]*)\}"), 1)), F.lit("")) != ""
    weak = (F.length(strip(x)) > 50) & x.rlike(r"[=+\-*/()\[\]\\]") & (fallback_answer(x) != "")
    return F.when(whole | box, 1.0).when(weak, 0.8).otherwise(0.0)


def trace_format(x: Column, longest: int = 1000) -> Column:
    """1 if tags balance and alternate think, (tool_call, think)*, one answer, and the answer has less than ``longest`` characters; else 0."""
    think, tool, answer = (count_of(x, f"<{t}>") for t in ("think", "tool_call", "answer"))
    even = (think == count_of(x, "</think>")) & (think > 0) & (tool == count_of(x, "</tool_call>")) & (answer == 1) & (count_of(x, "</answer>") == 1)
    s = strip(x)
    want = F.concat(F.array(F.lit("think")), F.flatten(F.array_repeat(F.array(F.lit("tool_call"), F.lit("think")), tool.cast("int"))), F.array(F.lit("answer")))
    order = F.startswith(s, F.lit("<think>")) & F.endswith(s, F.lit("</answer>")) & (F.regexp_extract_all(s, F.lit("<(think|tool_call|answer)>"), 1) == want)
    plain = x.rlike(r"(?s)\A\s*<think>.*?</think>\s*<answer>.*?</answer>\s*\z")
    short = F.length(strip(F.substring_index(F.substring_index(x, "<answer>", -1), "</answer>", 1))) < longest
    return F.when(even & short & F.when(tool == 0, plain).otherwise(order), 1.0).otherwise(0.0)


def boxed_format(x: Column) -> Column:
    """1 for a thought followed by a box, over the whole text."""
    return F.when(x.rlike(r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z"), 1.0).otherwise(0.0)


def judge_verdict(x: Column) -> Column:
    """1, 0.5 or 0 of a judge's reply; after "Judgement:" a 1 anywhere comes before 0.5."""
    s = strip(x)
    after = strip(F.substring_index(s, "Judgement:", -1))
    told = F.when(F.contains(after, F.lit("1")), 1.0).when(F.contains(after, F.lit("0.5")), 0.5).otherwise(0.0)
    return F.when(F.contains(s, F.lit("Judgement:")), told).otherwise(F.when(s == "1", 1.0).when(s == "0.5", 0.5).otherwise(0.0))


def tagged_exact_match(x: Column, golds: Column, format_score: float = 0.0, score: float = 1.0) -> Column:
    """Exact match of the last answer; a quarter of the score where over ten answer tags stand."""
    answer = last(F.regexp_extract_all(x, F.lit(r"(?s)<answer>(.*?)</answer>"), 1))
    right = F.exists(golds, lambda g: normalize_answer(g) == normalize_answer(strip(answer)))
    many = (count_of(x, "<answer>") > 10) | (count_of(x, "</answer>") > 10)
    return F.when(answer.isNull(), 0.0).when(right, F.when(many, score / 4).otherwise(score)).otherwise(format_score)


def crop_interval(x: Column) -> Column:
    """(start, end) of the last crop_video call that has both times; calls are literals in single or double quotes."""
    kind = "name string, arguments struct<start_time: string, end_time: string>"
    calls = F.transform(F.regexp_extract_all(x, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), 1), lambda c: F.from_json(c, kind, {"allowSingleQuotes": "true"}))
    times = F.transform(F.filter(calls, lambda c: c["name"] == "crop_video"), lambda c: F.struct(c["arguments"]["start_time"].try_cast("double").alias("start"), c["arguments"]["end_time"].try_cast("double").alias("end")))
    return last(F.filter(times, lambda t: t["start"].isNotNull() & t["end"].isNotNull()))


def _interval(x: Column) -> Column:
    ends = F.from_json(strip(x), "array<double>")
    return F.when(F.size(ends) == 2, ends)


def grounding_reward(x: Column, truth: Column, recall: bool = False) -> Column:
    """(score, acc, format) of an answer [start, end]: overlap with the truth plus format."""
    last_part = F.substring_index(x, "</think>", -1)
    think, tool = count_of(x, "<think>"), count_of(x, "<tool_call>")
    opened, closed = count_of(last_part, "<answer>"), count_of(last_part, "</answer>")
    even = (think == count_of(x, "</think>")) & (think > 0) & (tool == count_of(x, "</tool_call>")) & (opened == closed) & (opened > 0)
    s = strip(x)
    shape = F.when(tool == 0, x.rlike(r"(?s)\A\s*<think>.*?</think>\s*<answer>.*?</answer>\s*\z")).otherwise(F.startswith(s, F.lit("<think>")) & F.endswith(s, F.lit("</answer>")))
    said = F.when((opened > 0) & (closed > 0), _interval(F.substring_index(F.substring_index(x, "<answer>", -1), "</answer>", 1)))
    want = _interval(truth)
    share = (interval_recall if recall else interval_iou)(said[0], said[1], want[0], want[1])
    acc = F.coalesce(F.when(said.isNotNull() & want.isNotNull(), share), F.lit(0.0))
    form = F.when(even & shape, 1.0).otherwise(0.0)
    return F.struct((acc + form).alias("score"), acc.alias("acc"), form.alias("format"))


def composite_reward(x: Column, acc: Column, start: Column, end: Column, kind: str = "weighted") -> Column:
    """(score, format, extra) of a reply with a known accuracy.

    ``weighted``: 0.8 of accuracy and 0.2 of format; ``equal``: their sum.  The others add to
    the sum: ``tool`` 1 for a right reply that has used a tool; ``recall`` or ``iou`` the overlap
    of the last video crop with [start, end] if a tool has replied.
    """
    form = format_ok(x)
    used = F.contains(x, F.lit("<tool_response>"))
    if kind in ("weighted", "equal"):
        weights = (0.8, 0.2) if kind == "weighted" else (1.0, 1.0)
        return F.struct((weights[0] * acc + weights[1] * form).alias("score"), form.alias("format"), F.lit(0.0).alias("extra"))
    if kind == "tool":
        extra = F.when(used & (acc >= 0.5), 1.0).otherwise(0.0)
    elif kind in ("recall", "iou"):
        share = interval_recall if kind == "recall" else interval_iou
        extra = F.coalesce(F.when(used, let(crop_interval(x), lambda c: share(c["start"], c["end"], start, end))), F.lit(0.0))
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return F.struct((acc + form + extra).alias("score"), form.alias("format"), extra.alias("extra"))


def valid_box(left: Column, top: Column, right: Column, bottom: Column, small: float = 30, ratio: float = 100) -> Column:
    """Whether a box has an area, both sides longer than ``small``, and the longer at most ``ratio`` times the shorter."""
    w, h = right - left, bottom - top
    return F.coalesce((w > 0) & (h > 0) & (F.least(w, h) > small) & (F.greatest(w, h) <= ratio * F.least(w, h)), F.lit(False))


def fitted_box(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column, least: int = 28, small: float = 30, ratio: float = 100) -> Column:
    """(left, top, right, bottom) inside an image, grown around its centre until its shorter side has ``least``; null for a box that is not valid before or after."""
    inside = [F.greatest(left, F.lit(0)), F.greatest(top, F.lit(0)), F.least(right, width), F.least(bottom, height)]
    names = ("left", "top", "right", "bottom")
    box = F.struct(*[x.cast("double").alias(n) for x, n in zip(inside, names)])

    def grown(b: Column) -> Column:
        w, h = b["right"] - b["left"], b["bottom"] - b["top"]
        scale = least / F.least(w, h)
        half_w, half_h = F.ceil(w * scale * 0.5), F.ceil(h * scale * 0.5)
        x, y = (b["left"] + b["right"]) / 2, (b["top"] + b["bottom"]) / 2
        larger = F.struct(*[v.cast("double").alias(n) for v, n in zip((F.floor(x - half_w), F.floor(y - half_h), F.ceil(x + half_w), F.ceil(y + half_h)), names)])
        return F.when(F.least(w, h) >= least, b).otherwise(let(larger, lambda g: F.when(valid_box(*[g[n] for n in names], small, ratio), g)))

    given = left.isNotNull() & top.isNotNull() & right.isNotNull() & bottom.isNotNull()
    return let(box, lambda b: F.when(given & valid_box(*[b[n] for n in names], small, ratio), grown(b)))


def kept_area(width: Column, height: Column, most: float) -> Column:
    """(width, height) of a picture, shrunk in proportion to an area of ``most`` if it is larger; no side below 1."""
    scale = F.sqrt(F.lit(float(most)) / (width.cast("double") * height))
    side = lambda x: F.when(width.cast("double") * height <= most, x.cast("long")).otherwise(F.greatest(F.lit(1), F.floor(x * scale)).cast("long"))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def same_output(lines: Column, truth: Column) -> Column:
    """A program's output lines against the expected text: joined and stripped, or each line stripped."""
    want = strip(truth)
    return (strip(F.array_join(lines, "\n")) == want) | (strip(F.array_join(F.transform(lines, strip), "\n")) == want)


def pass_fraction(passed: Column, first: int = 10) -> Column:
    """Share of the first tests that pass."""
    head = F.slice(passed, 1, first)
    return F.when(F.size(head) > 0, F.aggregate(head, F.lit(0.0), lambda a, p: a + p.cast("double")) / F.size(head)).otherwise(0.0)


def print_last_line(code: Column) -> Column:
    """Code whose last non-empty line is printed unless it prints already."""
    lines = F.split(code, "\n")
    at = F.array_max(F.transform(lines, lambda v, i: F.when(v != "", i)))
    return F.array_join(F.transform(lines, lambda v, i: F.when((i == at) & ~F.startswith(v, F.lit("print")), F.concat(F.lit("print("), v, F.lit(")"))).otherwise(v)), "\n")


def passages(docs: Column) -> Column:
    """Retrieved texts as one string: a numbered title (the first line) and the rest of each."""
    one = lambda d, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), F.substring_index(d, "\n", 1), F.lit(")\n"), F.when(F.contains(d, F.lit("\n")), F.right(d, F.length(d) - F.position(F.lit("\n"), d))).otherwise(F.lit("")), F.lit("\n\n"))
    return strip(F.array_join(F.transform(docs, one), ""))


_EVENT = r"^Video_event\s+(.+?)\s*\[\s*([\d.]+)s\s*[\u2013-]\s*([\d.]+)s\]\s*:\s*(.+)$"


def event_line(x: Column) -> Column:
    """(ids, start, end, text) of a line "Video_event ids [s - e]: text", null if it is none."""
    g = lambda i: F.regexp_extract(x, _EVENT, i)
    return F.when(x.rlike(_EVENT), F.struct(strip(g(1)).alias("ids"), g(2).try_cast("double").alias("start"), g(3).try_cast("double").alias("end"), strip(g(4)).alias("text")))


def sorted_event_lines(x: Column) -> Column:
    """The event lines of a text in order of start and end, with one decimal."""
    lines = F.filter(F.transform(F.split(x, "\n"), lambda v, i: F.struct(event_line(strip(v)).alias("e"), i.alias("i"))), lambda s: s["e"].isNotNull())
    rows = F.array_sort(F.transform(lines, lambda s: F.struct(s["e"]["start"].alias("start"), s["e"]["end"].alias("end"), s["i"].alias("i"), s["e"]["ids"].alias("ids"), s["e"]["text"].alias("text"))))
    return F.transform(rows, lambda s: F.format_string("Video_event %s [%.1fs \u2013 %.1fs]: %s", s["ids"], s["start"], s["end"], s["text"]))


def trace_messages(x: Column) -> Column:
    """(role, content, code) turns of a trace with <code>, <interpreter> and <answer> elements; text outside them belongs to the assistant turn it precedes."""
    turn = r"(?s)(.*?)<(code|interpreter|answer)>(.*?)</(?:code|interpreter|answer)>"
    found = F.transform(F.regexp_extract_all(x, F.lit(turn), 0), lambda m: F.struct(F.regexp_extract(m, turn, 1).alias("before"), F.regexp_extract(m, turn, 2).alias("tag"), F.regexp_extract(m, turn, 3).alias("body")))
    fenced = r"(?s)```python(.*?)```"

    def message(m: Column) -> Column:
        code = F.when(m["body"].rlike(fenced), strip(F.regexp_extract(m["body"], fenced, 1))).otherwise(m["body"])
        role = F.when(m["tag"] == "interpreter", "tool").otherwise("assistant")
        content = F.when(m["tag"] == "interpreter", m["body"]).when(m["tag"] == "answer", F.concat(m["before"], m["body"])).otherwise(m["before"])
        return F.struct(role.alias("role"), strip(content).alias("content"), F.when(m["tag"] == "code", code).alias("code"))

    return F.transform(found, message)


def rounds_for(name: Column, seconds: Column, low: float = 900.0, high: float = 1200.0) -> Column:
    """1 or 2 rounds: 2 with a probability that grows from 0 at ``low`` to 1 at ``high``; the draw is a hash of the name."""
    share = (F.least(F.greatest(seconds, F.lit(low)), F.lit(high)) - low) / (high - low)
    draw = F.pmod(F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(1 << 24)) / (1 << 24)
    return F.when(seconds.isNull() | F.isnan(seconds) | (seconds < low) | (seconds == float("inf")), 1).otherwise(F.when(draw < share, 2).otherwise(1))


def trim_zeros(x: Column) -> Column:
    """A number without trailing zeros; other text as it is."""
    number = x.try_cast("double")
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.12f", number), r"0+\z", ""), r"\.\z", "")
    return F.when(number.isNull(), x).otherwise(text)
