"""String extraction, normalisation and scoring as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARTICLES = r"\b(a|an|the)\b"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once for the row; keeps plans small where a value is used again and again."""
    return F.transform(F.array(value), body)[0]


def steps(value: Column, *bodies) -> Column:
    for body in bodies:
        value = let(value, body)
    return value


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that what follows sees as plain ones: the optimiser does not put their expressions into later ones."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


# How replies mark an answer.
ANSWER_TAG = r"(?s)<answer>(.*?)</answer>"
FLAT_BOX = r"\\boxed\{([^{}]*)\}"
MARKED_NUMBER = r"#### (\-?[0-9\.\,]+)"
ANY_NUMBER = r"(\-?[0-9\.\,]+)"
ANSWER_LINE = r"(?i)Answer\s*:\s*([^\n]+)"
ANSWER_LETTER = r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?"


def blank_to_null(x: Column) -> Column:
    return F.when(x != "", x)


def last(xs: Column) -> Column:
    return F.try_element_at(xs, F.lit(-1))


def first_answer(x: Column) -> Column:
    """Text of the first <answer> element, '' if none."""
    return F.regexp_extract(x, ANSWER_TAG, 1)


def last_answer(x: Column) -> Column:
    """Trimmed text of the last <answer> element, null if none."""
    return F.trim(last(F.regexp_extract_all(x, F.lit(ANSWER_TAG), 1)))


def between(x: Column, left: str, right: str) -> Column:
    """After the last ``left``, before the next ``right``, trimmed."""
    return F.trim(F.substring_index(F.substring_index(x, left, -1), right, 1))


def last_boxed(x: Column) -> Column:
    """Content of the last \\boxed{} without nested braces."""
    return last(F.regexp_extract_all(x, F.lit(FLAT_BOX), 1))


def last_boxed_balanced(x: Column) -> Column:
    """Content of the last \\boxed{}, braces balanced; null if it never closes. A fold over what follows the last box."""
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
    step = lambda s, c: F.when(s["depth"] == 0, s).otherwise(F.struct((s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("depth"), (s["n"] + 1).alias("n")))
    cut = lambda tail: let(F.aggregate(F.split(tail, ""), start, step), lambda end: F.when(end["depth"] == 0, F.substring(tail, F.lit(1), end["n"] - 1)))
    return let(F.when(x.contains("\\boxed{"), F.substring_index(x, "\\boxed{", -1)), cut)


def gsm8k_answer(x: Column, strict: bool = True) -> Column:
    """Number after the last ####, or (not strict) the last number, of the last 300 characters, without , and $."""
    tail = F.right(x, F.lit(300))
    found = last(F.regexp_extract_all(tail, F.lit(MARKED_NUMBER), 1)) if strict else last(F.filter(F.regexp_extract_all(tail, F.lit(ANY_NUMBER), 1), lambda v: ~v.isin("", ".")))
    return F.translate(found, ",$", "")


def minerva_answer(x: Column) -> Column:
    return F.coalesce(F.trim(last(F.regexp_extract_all(x, F.lit(ANSWER_LINE), 1))), F.lit("[INVALID]"))


def letter_answer(x: Column) -> Column:
    """First "Answer: X" with X of A-D; '' if none."""
    return F.regexp_extract(x, ANSWER_LETTER, 1)


def numbers(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"), 1)


def subset_name(x: Column) -> Column:
    return F.regexp_extract(x, r"^split_(.+?)_\d+$", 1)


def last_code_block(x: Column, language: str = "python") -> Column:
    return F.when(x.contains(f"```{language}"), F.substring_index(F.substring_index(x, f"```{language}", -1), "```", 1))


def normalize_answer(x: Column) -> Column:
    """Lower case, no punctuation, no articles, single spaces."""
    y = F.translate(F.lower(x), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(y, ARTICLES, " "), r"\s+", " "))


def exact_match(pred: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: normalize_answer(g) == normalize_answer(pred)).cast("int")


def sub_match(pred: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: F.contains(normalize_answer(pred), normalize_answer(g))).cast("int")


def relaxed_match(pred: Column, truth: Column, portion: float = 0.9) -> Column:
    """Equal when trimmed, or one holds the other and is at most 1 / portion as long."""
    a, b = F.trim(pred), F.trim(truth)
    la, lb = F.length(a), F.length(b)
    return ((a == b) | (F.contains(a, b) & (lb >= portion * la)) | (F.contains(b, a) & (la >= portion * lb))).cast("int")


def strip_dot(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(x), r"\.\z", ""))


def collapse_spaces(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def format_ok(x: Column) -> Column:
    """1.0 if the whole text is <think>..</think>..<answer>..</answer>."""
    return F.when(x.rlike(r"(?s)\A\s*<think>.*</think>.*<answer>.*</answer>\s*\z"), 1.0).otherwise(0.0)


def count_of(x: Column, needle: str) -> Column:
    return ((F.length(x) - F.length(F.replace(x, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def tags_balanced(x: Column, *tags: str) -> Column:
    out = F.lit(True)
    for t in tags:
        out = out & (count_of(x, f"<{t}>") == count_of(x, f"</{t}>"))
    return out


def interval_iou(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Of [a, b] and [c, d]: intersection over hull, 0 if disjoint."""
    inter = F.greatest(F.least(b, d) - F.greatest(a, c), F.lit(0.0))
    hull = F.greatest(b, d) - F.least(a, c)
    return F.when(hull > 0, inter / hull).otherwise(0.0)


def interval_recall(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Share of [c, d] that [a, b] covers."""
    return F.when(d > c, F.greatest(F.least(b, d) - F.greatest(a, c), F.lit(0.0)) / (d - c)).otherwise(0.0)


def judge_score(x: Column) -> Column:
    """Last number of a reply; above 1 it is a percentage."""
    v = last(numbers(x)).cast("double")
    return F.when(v > 1, v / 100).otherwise(v)


def clock_seconds(x: Column) -> Column:
    """HH:MM:SS,mmm or HH:MM:SS.mmm in seconds."""
    p = F.split(F.replace(x, F.lit(","), F.lit(".")), ":")
    return F.get(p, F.lit(0)).try_cast("double") * 3600 + F.get(p, F.lit(1)).try_cast("double") * 60 + F.get(p, F.lit(2)).try_cast("double")


def uniform_frames(total: Column, n: int) -> Column:
    """n frame indices evenly over 0..total-1, ends included."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (total - 1) / (n - 1)).cast("long"))


def truncate(x: Column, limit: int, side: str) -> Column:
    """Over-long tool responses: "left" keeps the head, "right" the tail, "middle" both ends."""
    half = limit // 2
    cut = {"left": F.concat(F.left(x, F.lit(limit)), F.lit("...(truncated)")), "right": F.concat(F.lit("(truncated)..."), F.right(x, F.lit(limit))), "middle": F.concat(F.left(x, F.lit(half)), F.lit("...(truncated)..."), F.right(x, F.lit(half)))}[side]
    return F.when(F.length(x) > limit, cut).otherwise(x)


def pad_array(x: Column, length: int, value, left: bool = False) -> Column:
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(x), F.lit(0)))
    return F.concat(fill, x) if left else F.concat(x, fill)


def numeric_equal(a: Column, b: Column, rel: float = 1e-4) -> Column:
    return F.abs(a - b) <= rel * F.greatest(F.abs(a), F.abs(b))


def utf8_units(text: Column) -> Column:
    """A string with one character for each UTF-8 byte of ``text``: edit distances of such strings count bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def closest_choice(pred: Column, choices: Column) -> Column:
    """Choice with the smallest edit distance; the first of equals; null without a prediction."""
    ranked = F.transform(choices, lambda c, i: F.struct(F.levenshtein(c, pred).alias("d"), i.alias("i"), c.alias("c")))
    return F.when(pred.isNotNull(), F.array_min(ranked)["c"])


def repetitiveness(text: str | None) -> float:
    """2 * sum of common prefixes of neighbouring suffixes over n (n + 1); 0 for up to one character. For a UDF.

    Suffixes are ranked by their first 1, 2, 4, .. characters; the ranks of all rounds
    then give the common prefix of two neighbours, the longest round first.
    """
    import numpy as np

    n = len(text or "")
    if n < 2:
        return 0.0
    ranks = [np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True)[1].astype(np.int64)]
    width = 1
    while ranks[-1].max() < n - 1 and width < n:
        r = ranks[-1]
        behind = np.concatenate([r[width:], np.full(min(width, n), -1)])  # past the end is least
        ranks.append(np.unique(r * (n + 1) + behind + 1, return_inverse=True)[1].astype(np.int64))
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        step = 1 << k
        inside = np.maximum(a, b) + step <= n
        same = np.zeros(n - 1, bool)
        same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        common[same] += step
        a[same] += step
        b[same] += step
    return float(2 * common.sum() / (n * (n + 1)))


def rpn(expression: str) -> float | None:
    """Value of an arithmetic expression by conversion to postfix; null if it is malformed."""
    import operator
    import re

    ops = {"+": (1, operator.add), "-": (1, operator.sub), "*": (2, operator.mul), "/": (2, operator.truediv)}
    out, stack = [], []

    def apply():
        f = ops[stack.pop()][1]
        b, a = out.pop(), out.pop()
        out.append(f(a, b))

    try:
        for tok in re.findall(r"\d+\.?\d*|[-+*/()]", expression or ""):
            if tok == "(":
                stack.append(tok)
            elif tok == ")":
                while stack[-1] != "(":
                    apply()
                stack.pop()
            elif tok in ops:
                while stack and stack[-1] != "(" and ops[stack[-1]][0] >= ops[tok][0]:
                    apply()
                stack.append(tok)
            else:
                out.append(float(tok))
        while stack:
            apply()
        return out[0] if len(out) == 1 else None
    except (IndexError, ZeroDivisionError, KeyError):
        return None
