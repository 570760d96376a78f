"""Identity of mathematical expressions by their values at random points.

An answer in LaTeX or plain notation becomes a tree of sums, products, powers and
functions.  Two trees of rational expressions are compared at points of the field of
integers modulo a prime: if they differ, they agree at a random point with a chance of
about degree / 2 ** 61.  Roots, other functions and powers with a variable exponent are
compared at random positive points in complex floating point.  Lists and tuples are
compared part by part, equations as their two sides' difference, up to a factor of -1.

Every letter is an unknown but \\pi; what cannot be read is equal to nothing.  The
functions take and give Python values; ``identical`` makes a column of them.
"""

from __future__ import annotations

import cmath
import hashlib
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = (1 << 61) - 1
TRIALS = 3
LONGEST = 1000
_TOKEN = re.compile(r"\s+|(?P<number>\d+(?:\.\d+)?|\.\d+)|(?P<name>\\?[A-Za-z]+)|(?P<sign>\*\*|[-+*/^(){}\[\]|_!=<>,])")
_FUNCTIONS = {"sqrt": cmath.sqrt, "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "ln": cmath.log, "log": cmath.log, "exp": cmath.exp}
_DROPPED = re.compile(r"\\(?:left|right|displaystyle|[,;:! ])|\$|~")
_CLOSING = {"(": ")", "[": "]", "{": "}"}


class Unreadable(ValueError):
    """Not an expression of this notation, or not one with a value in the field."""


def _tokens(text: str) -> list[tuple[str, str]]:
    text = _DROPPED.sub(" ", text).replace("\\cdot", "*").replace("\\times", "*").replace("\\div", "/").replace("−", "-").replace("·", "*").replace("×", "*").replace("÷", "/").replace("π", "\\pi").replace("√", "\\sqrt")
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise Unreadable(text[at])
        at = m.end()
        kind = m.lastgroup
        if kind == "name":
            word = m.group().lstrip("\\")
            if word in _FUNCTIONS or word in ("frac", "dfrac", "tfrac", "pi") or m.group().startswith("\\"):
                out.append(("name", word))
            else:
                out += [("name", letter) for letter in word]
        elif kind:
            out.append((kind, "^" if m.group() == "**" else m.group()))
    return out


class _Reader:
    """Precedence climbing: sums, then products (also without a sign), then the sign, then powers from the right."""

    def __init__(self, text: str):
        self.tokens, self.at, self.depth = _tokens(text), 0, 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, sign: str | None = None) -> tuple[str, str]:
        kind, value = self.peek()
        if kind == "end" or sign is not None and value != sign:
            raise Unreadable(sign or "end")
        self.at += 1
        return kind, value

    def whole(self):
        tree = self.sum()
        if self.peek()[0] != "end":
            raise Unreadable(self.peek()[1])
        return tree

    def sum(self):
        self.depth += 1
        if self.depth > 60:
            raise Unreadable("too deep")
        tree = self.product()
        while self.peek()[1] in ("+", "-") and self.peek()[0] == "sign":
            sign = self.take()[1]
            tree = (sign, tree, self.product())
        self.depth -= 1
        return tree

    def product(self):
        tree = self.signed()
        while True:
            kind, value = self.peek()
            if kind == "sign" and value in "*/":
                self.take()
                tree = (value, tree, self.signed())
            elif kind in ("number", "name") or value in ("(", "[", "{"):
                if kind == "number" and tree[0] == "number":
                    raise Unreadable("two numbers in a row")
                tree = ("*", tree, self.power())
            else:
                return tree

    def signed(self):
        kind, value = self.peek()
        if kind == "sign" and value in "+-":
            self.take()
            inner = self.signed()
            return inner if value == "+" else ("-", ("number", 0, 1), inner)
        return self.power()

    def power(self):
        base = self.atom()
        if self.peek()[1] == "^":
            self.take()
            return ("^", base, self.signed())
        return base

    def group(self):
        opened = self.take()[1]
        if opened not in _CLOSING:
            raise Unreadable(opened)
        tree = self.sum()
        self.take(_CLOSING[opened])
        return tree

    def argument(self):
        return self.group() if self.peek()[1] in _CLOSING else self.power()

    def atom(self):
        kind, value = self.peek()
        if kind == "number":
            self.take()
            places = len(value.partition(".")[2])
            return ("number", int(value.replace(".", "")), 10**places)
        if kind == "name":
            self.take()
            if value in ("frac", "dfrac", "tfrac"):
                parts = [self.group() if self.peek()[1] == "{" else self.digit() for _ in range(2)]
                return ("/", *parts)
            if value == "sqrt" and self.peek()[1] == "[":
                root = self.group()
                return ("^", self.argument(), ("/", ("number", 1, 1), root))
            if value in _FUNCTIONS:
                return ("call", value, self.argument())
            if self.peek()[1] == "_":
                self.take()
                value += "_" + ("".join(v for _, v in self.until_brace()) if self.peek()[1] == "{" else self.take()[1])
            return ("name", value)
        return self.group()

    def digit(self):
        """What an unbraced fraction takes: one figure or name; of a longer number the first figure."""
        kind, value = self.take()
        if kind == "number" and len(value) > 1 and value.isdigit():
            self.at -= 1
            self.tokens[self.at] = (kind, value[1:])
            value = value[0]
        if kind == "number":
            return ("number", int(value), 1) if value.isdigit() else ("number", int(value.replace(".", "")), 10 ** len(value.partition(".")[2]))
        if kind != "name" or value in _FUNCTIONS:
            raise Unreadable(value)
        return ("name", value)

    def until_brace(self):
        self.take("{")
        while self.peek()[1] != "}":
            yield self.take()
        self.take("}")


def _point(name: str, trial: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{name}/{trial}".encode(), digest_size=8).digest(), "big")


def _exponent(tree) -> int:
    """An integer without unknowns, not too large."""
    op = tree[0]
    if op == "number" and tree[1] % tree[2] == 0:
        value = tree[1] // tree[2]
    elif op in ("+", "-", "*"):
        a, b = _exponent(tree[1]), _exponent(tree[2])
        value = a + b if op == "+" else a - b if op == "-" else a * b
    else:
        raise Unreadable("exponent")
    if abs(value) > 1 << 40:
        raise Unreadable("exponent")
    return value


def in_field(tree, trial: int) -> int:
    op = tree[0]
    if op == "number":
        return tree[1] * pow(tree[2], -1, PRIME) % PRIME
    if op == "name":
        return _point(tree[1], trial) % PRIME
    if op == "call":
        raise Unreadable(tree[1])
    if op == "^":
        return pow(in_field(tree[1], trial), _exponent(tree[2]), PRIME)
    a, b = in_field(tree[1], trial), in_field(tree[2], trial)
    return {"+": a + b, "-": a - b, "*": a * b}[op] % PRIME if op != "/" else a * pow(b, -1, PRIME) % PRIME


def in_complex(tree, trial: int) -> complex:
    op = tree[0]
    if op == "number":
        return complex(tree[1] / tree[2])
    if op == "name":
        return complex(math.pi) if tree[1] == "pi" else complex(0.3 + 2.4 * _point(tree[1], trial) / 2**64)
    if op == "call":
        return _FUNCTIONS[tree[1]](in_complex(tree[2], trial))
    a, b = in_complex(tree[1], trial), in_complex(tree[2], trial)
    return a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b if op == "/" else a**b


def _values(tree, value) -> list:
    out = []
    for trial in range(TRIALS):
        try:
            out.append(value(tree, trial))
        except (ZeroDivisionError, OverflowError):
            out.append(None)
        except ValueError as e:
            if isinstance(e, Unreadable):
                raise
            out.append(None)  # no inverse, or outside a function's domain
    return out


def same_tree(a, b) -> bool:
    try:
        x, y = _values(a, in_field), _values(b, in_field)
        return x == y and None not in x
    except Unreadable:
        pass
    x, y = _values(a, in_complex), _values(b, in_complex)
    close = lambda p, q: cmath.isfinite(p) and abs(p - q) <= 1e-9 * max(1.0, abs(p), abs(q))
    return None not in x and None not in y and all(map(close, x, y))


def split_list(text: str) -> tuple[str, list[str], str]:
    """(opening bracket, parts at its commas, closing bracket) of a list or tuple; a single part without brackets."""
    text = text.strip()
    left = right = ""
    inner = text
    if len(text) > 1 and text[0] in "([" and text[-1] in ")]":
        left, inner, right = text[0], text[1:-1], text[-1]
    parts, depth, begin = [], 0, 0
    for i, ch in enumerate(inner):
        depth += (ch in "([{") - (ch in ")]}")
        if depth < 0:
            return "", [text], ""
        if ch == "," and depth == 0:
            parts.append(inner[begin:i])
            begin = i + 1
    parts.append(inner[begin:])
    return (left, parts, right) if len(parts) > 1 else ("", [text], "")


def _same_part(a: str, b: str) -> bool:
    sides = [x.split("=") for x in (a, b)]
    if len(sides[0]) != len(sides[1]) or len(sides[0]) > 2:
        return False
    trees = [[_Reader(s).whole() for s in x] for x in sides]
    if len(trees[0]) == 1:
        return same_tree(trees[0][0], trees[1][0])
    left, right = (("-", *t) for t in trees)
    return same_tree(left, right) or same_tree(left, ("-", ("number", 0, 1), right))


def same_expression(a: str | None, b: str | None) -> bool:
    """Whether two answers are the same mathematically; null, empty, over-long and unreadable answers are equal to nothing."""
    if not a or not b or max(len(a), len(b)) > LONGEST:
        return False
    (la, pa, ra), (lb, pb, rb) = split_list(a.replace("\\left", "").replace("\\right", "")), split_list(b.replace("\\left", "").replace("\\right", ""))
    if len(pa) != len(pb) or (la, ra) != (lb, rb):
        return False
    try:
        return all(_same_part(x, y) for x, y in zip(pa, pb))
    except (Unreadable, RecursionError):
        return False


def last_box(text: str | None) -> str | None:
    """What the last box of a text holds, braces balanced."""
    if not text or (at := text.rfind("\\boxed{")) < 0:
        return None
    depth, begin = 0, at + 7
    for i in range(begin - 1, min(len(text), begin + LONGEST + 1)):
        depth += (text[i] == "{") - (text[i] == "}")
        if not depth:
            return text[begin:i]
    return None


def identical(a: Column, b: Column) -> Column:
    """Whether two columns hold the same expressions, in Arrow batches.

    Give it columns of a table, not expressions with lambda functions: Spark finds a
    Python function by its arguments' canonical form, which those do not always have.
    """

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([same_expression(p, q) for p, q in zip(x, y)], dtype="bool")

    return F.pandas_udf(run, "boolean")(a, b)


def identical_to_any(x: Column, truths: Column) -> Column:
    """Whether the last box of a text holds the same expression as one of an array of texts, boxed or not."""

    def run(texts: pd.Series, held: pd.Series) -> pd.Series:
        return pd.Series([p is not None and q is not None and any(same_expression(p, last_box(y) or y) for y in q) for p, q in zip(map(last_box, texts), held)], dtype="bool")

    return F.pandas_udf(run, "boolean")(x, truths)
