"""Test runs of generated programs: each program runs in a process of its own, with limits of time and memory.

A test's input goes to the program's standard input and its output is compared line by
line without outer space; with a function name, the input's lines are JSON arguments of
that function (or of a method of ``Solution``) and the value is compared as JSON.
"""

from __future__ import annotations

import json
import subprocess
import sys

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import last_code_block

_CALL = """
import json as _j, sys as _s
_f = globals().get({name!r}) or getattr(Solution(), {name!r})
print(_j.dumps(_f(*[_j.loads(x) for x in _s.stdin.read().splitlines() if x.strip()])))
"""


def run_program(code: str, given: str, seconds: float = 10.0, megabytes: int = 1024) -> str | None:
    """Standard output, or null if the program fails or takes too much. It sees no environment and none of the caller's modules' paths."""

    def limit():
        import resource

        resource.setrlimit(resource.RLIMIT_AS, (megabytes << 20, megabytes << 20))
        resource.setrlimit(resource.RLIMIT_CPU, (int(seconds) + 1, int(seconds) + 1))

    try:
        done = subprocess.run([sys.executable, "-I", "-S", "-c", code], input=given, capture_output=True, text=True, timeout=seconds, env={}, preexec_fn=limit)
    except (subprocess.TimeoutExpired, OSError, ValueError):
        return None
    return done.stdout if done.returncode == 0 else None


def _lines(text: str) -> list[str]:
    return [x.strip() for x in text.strip().splitlines()]


def passes(code: str, tests: dict, at: int, seconds: float = 10.0) -> bool:
    """Whether a program passes one test of {"inputs": [..], "outputs": [..], "fn_name": ..}."""
    given, wanted, name = tests["inputs"][at], tests["outputs"][at], tests.get("fn_name")
    if name:
        given = given if isinstance(given, str) else "\n".join(json.dumps(x) for x in given)
        out = run_program(code + _CALL.format(name=name), given, seconds)
        wanted = json.loads(wanted) if isinstance(wanted, str) else wanted
        try:
            got = json.loads(_lines(out)[-1]) if out else None
        except (ValueError, IndexError):
            return False
        return out is not None and (got == wanted or [got] == wanted)
    given, wanted = ("\n".join(x) if isinstance(x, list) else x for x in (given, wanted))
    out = run_program(code, given, seconds)
    return out is not None and _lines(out) == _lines(wanted)


def pass_share(code: str | None, tests: str | None, first: int = 10) -> float | None:
    """Share of the first ``first`` tests that pass; null without a program, 0 where the tests cannot be read or there are none."""
    if code is None:
        return None
    try:
        held = json.loads(tests or "")
        n = min(first, len(held["inputs"]))
        return sum(passes(code, held, i) for i in range(n)) / n if n else 0.0
    except (ValueError, KeyError, TypeError, IndexError):
        return 0.0


def code_score(response: Column, tests: Column) -> Column:
    """Share of tests that the last code block of a response, or a response without one, passes; in Arrow batches."""

    def run(code: pd.Series, held: pd.Series) -> pd.Series:
        return pd.Series([pass_share(c, t) for c, t in zip(code, held)], dtype="float64")

    return F.pandas_udf(run, "double")(F.coalesce(last_code_block(response), F.substring_index(response, "```", 1)), tests)
