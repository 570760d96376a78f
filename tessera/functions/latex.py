"""Normal forms and equality of mathematical answers as Spark columns."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import algebra
from tessera.functions.choices import strip
from tessera.functions.text import last, last_boxed_balanced, let, steps

# Replacements of a final answer, in this order.
SUBSTITUTIONS = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
# What is removed from a final answer, in this order.
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds",
    "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}",
    "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]
# Units that an answer may carry.
UNITS = ["degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard", "liter"]


def _replace(x: Column, *pairs: tuple[str, str]) -> Column:
    for before, after in pairs:
        x = F.replace(x, F.lit(before), F.lit(after))
    return x


def final_answer(x: Column) -> Column:
    """Normal form of a quantitative answer: what follows the last =, without units, decoration and shorthand."""
    x = _replace(F.substring_index(x, "=", -1), *SUBSTITUTIONS, *((w, "") for w in REMOVED))
    # fixed values: patterns and what they become, in this order
    for pattern, after in (
        (r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"), (r"(\\text\{)(.*?)(\})", "$2"), (r"(\\textbf\{)(.*?)(\})", "$2"), (r"(\\overline\{)(.*?)(\})", "$2"), (r"(\\boxed\{)(.*)(\})", "$2"),
        (r"(frac)([^{])(.)", "frac{$2}{$3}"), (r"(sqrt)([^{])", "sqrt{$2}"),
    ):
        x = F.regexp_replace(x, pattern, after)
    return strip(let(_replace(x, ("$", "")), lambda v: F.when(_replace(v, (",", "")).rlike(r"\A\d+\z"), _replace(v, (",", ""))).otherwise(v)))


def canonical(x: Column) -> Column:
    """Normal form of a LaTeX answer: fractions and roots braced, no spaces, units or decoration; null where the form is broken."""
    # fixed values: replacements, in this order
    x = _replace(x, ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""))

    def fractions(v: Column) -> Column:
        full = F.regexp_replace(F.regexp_replace(v, r"\\frac([^{\\])([^{])", r"\\frac{$1}{$2}"), r"\\frac([^{])\{", r"\\frac{$1}{")
        return F.when(v.rlike(r"\\frac(\z|\\frac)"), None).when(v.rlike(r"\\frac[^{](\z|\\frac)"), v).otherwise(full)

    return steps(
        x,
        lambda v: let(F.split(v, r"\\text\{ ", -1), lambda units: F.when(F.size(units) <= 2, _replace(units[0], ("\\%", ""), (" .", " 0."), ("{.", "{0.")))),
        lambda v: F.when(F.startswith(v, F.lit(".")), F.concat(F.lit("0"), v)).otherwise(v),
        lambda v: let(F.split(v, "=", -1), lambda sides: F.when((F.size(sides) == 2) & (F.length(sides[0]) <= 2), F.get(sides, F.lit(1))).otherwise(v)),
        lambda v: F.when(~v.rlike(r"\\sqrt(\z|\\sqrt)"), _replace(F.regexp_replace(v, r"\\sqrt([^{])", r"\\sqrt{$1}"), (" ", ""))),
        fractions,
        lambda v: F.when(v == "0.5", "\\frac{1}{2}").otherwise(F.regexp_replace(v, r"\A(0|-?[1-9]\d*)/(0|-?[1-9]\d*)\z", r"\\frac{$1}{$2}")),
    )


def equivalent(a: Column, b: Column) -> Column:
    """Equality of two answers in canonical form; as they stand where a form is broken. Two nulls are equal."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.coalesce(canonical(a) == canonical(b), a == b))


def boxed(x: Column) -> Column:
    """The last box of a text with its command, "\\boxed{..}"; null if there is none or it does not close."""
    inner = last_boxed_balanced(x)
    return F.when(F.contains(x, F.lit("\\boxed ")), F.concat(F.lit("\\boxed "), F.substring_index(F.substring_index(x, "\\boxed ", -1), "$", 1))).otherwise(F.concat(F.lit("\\boxed{"), inner, F.lit("}")))


def unboxed(x: Column) -> Column:
    """Without the box around a text; null if it is not one box."""
    spaced = F.contains(x, F.lit("\\boxed "))
    return F.when(spaced & F.startswith(x, F.lit("\\boxed ")), F.substring(x, F.lit(8), F.length(x))).when(~spaced & F.startswith(x, F.lit("\\boxed{")) & F.endswith(x, F.lit("}")), F.substring(x, F.lit(8), F.length(x) - 8))


def box_content(x: Column) -> Column:
    """What the last box holds; null if there is none."""
    return steps(x, boxed, unboxed)


def boxed_score(x: Column, truth: Column) -> Column:
    """1 if the last box is equivalent to the truth."""
    return let(box_content(x), lambda answer: F.when(answer.isNotNull() & equivalent(answer, truth), 1.0).otherwise(0.0))


def boxed_equal(x: Column, truth: Column) -> Column:
    """1 if the last box holds exactly the truth."""
    return F.coalesce((box_content(x) == truth).cast("int"), F.lit(0))


def minerva_score(x: Column, truth: Column) -> Column:
    """(score, acc, pred): plus or minus one for the last "Answer:" of the last 300 characters."""
    said = F.coalesce(last(F.regexp_extract_all(F.right(x, F.lit(300)), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), 1)), F.lit("[INVALID]"))
    scored = lambda pred, right: F.struct(F.when(right, 1.0).otherwise(-1.0).alias("score"), right.alias("acc"), pred.alias("pred"))
    return let(final_answer(said), lambda pred: let(pred == final_answer(truth), lambda right: scored(pred, right)))


# What stands before a final answer, after it, and right before its value, in this order.
ANSWER_BEFORE = ["answer:", "answer is", "answers are"]
ANSWER_AFTER = ["is answer", "is the answer", "are answers", "are the answers"]
VALUE_BEFORE = ["be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n"]


def stated_answer(x: Column) -> Column:
    """The answer that a reply states: what follows the last mark of an answer, in its last box if there is one, without a last sentence's end and lead."""
    cut = lambda v, pattern, kept: strip(F.regexp_replace(v, pattern, kept))  # noqa: E731  without the pattern it only loses outer space
    for mark in ANSWER_BEFORE:
        x = cut(x, rf"(?is)\A.*{mark}", "")
    for mark in ANSWER_AFTER:
        x = cut(x, rf"(?is)\A(.*){mark}.*\z", "$1")
    x = let(x, lambda v: F.coalesce(F.nullif(strip(last_boxed_balanced(v)), F.lit("")), v))
    x = cut(x, r"(?s)\A(.*)\. .*\z", "$1")
    for mark in VALUE_BEFORE:
        x = cut(x, rf"(?is)\A.*{mark}", "")
    return x


def stated_score(x: Column, truth: Column) -> Column:
    """1 if a stated answer equals the truth by spoken form, value or identity of expressions."""
    return F.coalesce((graded_equal(x, truth) | math_equal(x, truth)).cast("double"), F.lit(0.0))


def plain_commas(x: Column) -> Column:
    """Without the commas of well-formed large numbers."""
    return F.regexp_replace(x, r"(?<=\d),(?=\d{3}(\D|\z|,\d{3}))", "")


def spoken_form(x: Column) -> Column:
    """Normal form of a spoken or typeset answer: no units, money and percent signs, mixed numbers summed, lower case."""
    # fixed values: replacements, in this order
    x = F.regexp_replace(x, r"\A\\text\{(.+?)\}\z", "$1")
    x = _replace(x, ("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "), ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12"))
    for unit in UNITS:
        x = F.regexp_replace(x, rf"{unit}(es)?(s)? *(\^[0-9]+)?", "")
    x = F.regexp_replace(x, r"\^ *\\circ", "")
    braces = lambda v: F.when(F.startswith(v, F.lit("{")) & F.endswith(v, F.lit("}")) & (F.length(v) > 1), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    signs = lambda v: F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r",\\! *", ""), "- *", "-"), "([0-9]) +([0-9])", "$1+$2"))
    whole = lambda n: F.when(F.abs(n - F.round(n)) <= 1e-7, F.round(n).cast("bigint").cast("string"))
    return steps(x, braces, signs, lambda v: F.coalesce(let(plain_commas(strip(v)).try_cast("double"), whole), F.replace(v, F.lit(" "), F.lit(""))))


def number_of(x: Column) -> Column:
    """Value of a decimal, a percentage, "a/b" or "\\frac{a}{b}", or null."""
    bare = lambda v: F.when(v.rlike(r"\A\$\d"), F.substring(v, F.lit(2), F.length(v))).otherwise(F.regexp_replace(v, r"\\?%\z", ""))
    return steps(_replace(strip(x), ("{,}", ""), (" ", "")), bare, _number)


def _number(x: Column) -> Column:
    parts = r"\A(-?)(?:\\frac\{(-?\d+(?:\.\d+)?)\}\{(-?\d+(?:\.\d+)?)\}|(\d+(?:\.\d+)?)/(\d+(?:\.\d+)?))\z"
    top = F.coalesce(F.nullif(F.regexp_extract(x, parts, 2), F.lit("")), F.nullif(F.regexp_extract(x, parts, 4), F.lit(""))).try_cast("double")
    down = F.coalesce(F.nullif(F.regexp_extract(x, parts, 3), F.lit("")), F.nullif(F.regexp_extract(x, parts, 5), F.lit(""))).try_cast("double")
    ratio = F.when(down != 0, F.when(F.regexp_extract(x, parts, 1) == "-", -1.0).otherwise(1.0) * top / down)
    return F.coalesce(_replace(x, (",", "")).try_cast("double"), ratio)


def close(a: Column, b: Column, rel: float = 1e-4) -> Column:
    return (a == b) | (F.abs(a - b) <= rel * F.greatest(F.abs(a), F.abs(b)))


def _same_value(p: Column, r: Column, percent: bool, rel: float) -> Column:
    """One number or text against another; a number also as a hundredth or a hundredfold."""
    scaled = lambda a, b: close(b, a, rel) | (close(b / 100, a, rel) | close(b * 100, a, rel) if percent else F.lit(False))
    bare = lambda x: F.translate(F.replace(x, F.lit(" "), F.lit("")), "{}()[]", "")
    texts = (F.lower(strip(p)) == F.lower(strip(r))) | (bare(p) == bare(r))
    return let(number_of(p), lambda a: let(number_of(r), lambda b: F.when(a.isNotNull() & b.isNotNull(), scaled(a, b)).otherwise(texts)))


def math_equal(pred: Column, ref: Column, percent: bool = True, rel: float = 1e-4) -> Column:
    """Equality of answers: numbers to a relative tolerance (also as percentages), intervals and tuples part by part, matrices row by row, else texts or identical expressions."""
    rows = lambda x: F.regexp_replace(F.regexp_replace(x, r"\\begin\{[bp]?matrix\}|\\end\{[bp]?matrix\}", ""), r"\\\\|&", ",")
    inner = lambda x: F.split(F.regexp_replace(strip(rows(x)), r"\A[\[(]|[\])]\z", ""), ",")
    open_end = lambda x: F.regexp_replace(strip(x), r"(?s)\A([\[(]?).*?([\])]?)\z", "$1$2")
    ends = (open_end(pred) == open_end(ref)) | (open_end(pred) == "") | (open_end(ref) == "")
    listed = F.contains(rows(ref), F.lit(",")) & number_of(ref).isNull()
    each = lambda a, b: (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: _same_value(x, y, percent, rel)), lambda v: v)
    parts = let(inner(pred), lambda a: let(inner(ref), lambda b: each(a, b)))
    plain = F.coalesce(F.when(listed, (strip(pred) == strip(ref)) | (ends & parts)).otherwise(_same_value(pred, ref, percent, rel)), F.lit(False))
    numbers = number_of(pred).isNotNull() & number_of(ref).isNotNull()
    return plain | (~F.coalesce(numbers, F.lit(False)) & algebra.identical(pred, ref))


def graded_equal(given: Column, truth: Column) -> Column:
    """As ``spoken_equal``, or identical expressions; a fraction or a whole number on either side stays literal."""
    plain, a, b = spoken_equal(given, truth), spoken_form(given), spoken_form(truth)
    left = F.coalesce(~plain & ~(_ratio(a) & _ratio(b)) & (_whole(a) == _whole(b)), F.lit(False))
    return F.when(given.isNull() | truth.isNull(), False).otherwise(plain | (left & algebra.identical(given, truth)))


def _ratio(x: Column) -> Column:
    return x.rlike(r"\A-?[0-9]+.?/0*[1-9][0-9]*.?\z")


def _whole(x: Column) -> Column:
    return F.coalesce(let(x.try_cast("double"), lambda n: F.abs(n - F.round(n)) <= 1e-7), F.lit(False))


def spoken_equal(given: Column, truth: Column) -> Column:
    """Canonical or spoken forms agree, or each part of a tuple does: fractions and whole numbers literally, other parts by value."""

    def parts(x: Column) -> Column:
        y = plain_commas(x)
        return F.when(x.rlike(r"\A[(\[][^()\[\]]+[)\]]\z"), F.transform(F.split(F.regexp_replace(y, r"\A[(\[]|[)\]]\z", ""), ","), strip)).otherwise(F.array(y))

    def same(x: Column, y: Column) -> Column:
        return F.when(_ratio(x) & _ratio(y), x == y).when(_whole(x) != _whole(y), F.lit(False)).otherwise((x == y) | F.coalesce(number_of(x) == number_of(y), F.lit(False)))

    def spoken(a: Column, b: Column) -> Column:
        ends = lambda n: (n <= 1) | ((F.left(a, F.lit(1)) == F.left(b, F.lit(1))) & (F.right(a, F.lit(1)) == F.right(b, F.lit(1))))
        each = lambda x, y: (F.size(x) == F.size(y)) & ends(F.size(y)) & F.forall(F.zip_with(x, y, same), lambda v: v)
        return (a == b) | ((F.length(a) > 0) & let(parts(a), lambda x: let(parts(b), lambda y: each(x, y))))

    told = let(spoken_form(given), lambda a: let(spoken_form(truth), lambda b: spoken(a, b)))
    return F.when(given.isNull() | truth.isNull(), False).otherwise(equivalent(given, truth) | F.coalesce(told, F.lit(False)))


def graded_box(x: Column, golds: Column) -> Column:
    """(score, format_score, acc) of the last box against any of several truths."""
    found = F.contains(x, F.lit("\\boxed"))
    right = let(last_boxed_balanced(x), lambda answer: F.exists(golds, lambda g: let(F.coalesce(last_boxed_balanced(g), g), lambda t: spoken_equal(answer, t))))
    right = F.coalesce(right, F.lit(False)) | algebra.identical_to_any(x, golds)
    return let(F.coalesce(right, F.lit(False)) & found, lambda r: F.struct(r.cast("double").alias("score"), found.cast("double").alias("format_score"), r.alias("acc")))


def arithmetic(text: str | None) -> Fraction | None:
    """Exact value of an expression of numbers, + - * / ^, brackets and \\frac; null if it is anything else. For a UDF."""
    import re

    s = re.sub(r"\\d?frac\{([^{}]*)\}\{([^{}]*)\}", r"((\1)/(\2))", text or "").replace("\\cdot", "*").replace("\\times", "*").replace(" ", "")
    tokens = re.findall(r"\d+\.?\d*|\.\d+|[-+*/^()]", s)
    if not tokens or "".join(tokens) != s:
        return None
    tokens.append("")
    at = 0

    def atom() -> Fraction:
        nonlocal at
        t = tokens[at]
        at += 1
        if t == "(":
            v = total()
            if tokens[at] != ")":
                raise ValueError
            at += 1
        elif t in "+-" and t:
            v = atom() if t == "+" else -power()
        else:
            v = Fraction(t)
        return v

    def power() -> Fraction:
        nonlocal at
        v = atom()
        if tokens[at] == "^":
            at += 1
            e = power()
            if e.denominator != 1 or abs(e) > 64:
                raise ValueError
            v = v ** int(e)
        return v

    def term() -> Fraction:
        nonlocal at
        v = power()
        while tokens[at] in ("*", "/"):
            at += 1
            v = v * power() if tokens[at - 1] == "*" else v / power()
        return v

    def total() -> Fraction:
        nonlocal at
        v = term()
        while tokens[at] in ("+", "-"):
            at += 1
            v = v + term() if tokens[at - 1] == "+" else v - term()
        return v

    try:
        out = total()
        return out if at == len(tokens) - 1 else None
    except (ValueError, ZeroDivisionError, IndexError):
        return None


def value_of_tuple(text: str | None) -> str | None:
    """A tuple or list with its parts evaluated and rounded to two places; other text as it is. For a UDF."""
    if text is None or len(text) < 2 or (text[0], text[-1]) not in (("(", ")"), ("[", "]")) or "," not in text:
        return text
    out = []
    for part in text[1:-1].split(","):
        value = None if "infty" in part or part in ("a", "-a") else arithmetic(part)
        if value is None and not ("infty" in part or part in ("a", "-a")):
            return text
        out.append(part if value is None else str(round(value) if value.denominator == 1 else round(float(value), 2)))
    return f"{text[0]}{','.join(out)}{text[-1]}"


def evaluated_equal(answer: str | None, truth: str | None) -> bool:
    """Equal texts, tuples with equal parts, or expressions with equal values to two places. For a UDF."""
    a, b = (answer or "").lower(), (truth or "").lower()
    if not a.replace(" ", "") or not b.replace(" ", ""):
        return False
    if a.strip() == b.strip() or value_of_tuple(a) == value_of_tuple(b):
        return True
    x, y = arithmetic(a), arithmetic(b)
    return x is not None and y is not None and round(float(x), 2) == round(float(y), 2)
