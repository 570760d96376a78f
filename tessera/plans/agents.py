"""Agent loops, tools and interactions over rows: each conversation runs its own state machine inside a task.

A loop generates, parses tool calls, runs tools and appends their answers until a
limit is reached or no tool is called.  Tools and interactions are objects with a
state for each conversation, created at its start and released at its end.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import re
import types
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import Registry

AGENT_LOOPS = Registry("agent loop")
TOOL_PARSERS = Registry("tool parser")
CLIENTS = Registry("client")


class Tool:
    """A tool with a state for each conversation; ``execute`` gives its answer and a step reward."""

    name = "tool"

    def __init__(self):
        self.states: dict[str, dict] = {}

    def create(self, conversation: str, **state) -> None:
        self.states[conversation] = dict(state)

    def execute(self, conversation: str, arguments: dict) -> tuple[str, float]:
        raise NotImplementedError

    def calc_reward(self, conversation: str) -> float:
        return 0.0

    def release(self, conversation: str) -> None:
        self.states.pop(conversation, None)


class Scored:
    """What a conversation has been rated so far: ``rate`` takes a value, gives what the change costs, and says whether it may end."""

    def __init__(self, truth: str = "", penalty: float = 0.0, enough: float = 1.0):
        self.truth, self.penalty, self.enough, self.values = truth, penalty, enough, [0.0]

    def rate(self, value: float) -> tuple[float, bool]:
        self.values.append(value)
        return (-self.penalty if value <= self.values[-2] else 0.0), value >= self.enough

    @property
    def last(self) -> float:
        return self.values[-1]


class AnswerTool(Tool):
    """Rates each answer that it is given; one that is no better than the one before costs ``penalty``."""

    name = "answer"

    def __init__(self, penalty: float = 0.05):
        super().__init__()
        self.penalty = penalty

    def create(self, conversation, **state):
        self.states[conversation] = Scored(str(state.get("truth", "")), self.penalty)

    def execute(self, conversation, arguments):
        held = self.states[conversation]
        cost, _ = held.rate(1.0 if str(arguments.get("answer")) == held.truth else 0.0)
        return f"reward {held.last}", cost

    def calc_reward(self, conversation):
        return self.states[conversation].last


class Interaction:
    """A simulated user who rates the last answer by ``right`` and stops at a rating of ``enough``."""

    REPLIES = {True: "correct", False: "incorrect, try again"}

    def __init__(self, right: Callable[[str, str], bool], enough: float = 1.0):
        self.right, self.enough, self.states = right, enough, {}

    def start(self, conversation: str, truth: str) -> None:
        self.states[conversation] = Scored(truth, enough=self.enough)

    def respond(self, conversation: str, messages: list[dict]) -> tuple[bool, str, float]:
        held, answers = self.states[conversation], [m["content"] for m in messages if m["role"] == "assistant"]
        _, ends = held.rate(float(self.right(answers[-1] if answers else "", held.truth)))
        return ends, self.REPLIES[ends], held.last

    def finalize(self, conversation: str) -> float:
        return self.states.pop(conversation).last


@TOOL_PARSERS.register("tagged")
def tagged_calls(text: str) -> list[dict]:
    """JSON objects in <tool_call> elements; those that do not parse are left out."""
    out = []
    for body in re.findall(r"<tool_call>(.*?)</tool_call>", text, re.DOTALL):
        try:
            call = json.loads(body)
        except ValueError:
            continue
        if isinstance(call, dict) and "name" in call:
            out.append(call)
    return out


@dataclass
class Limits:
    response: int = 1 << 30
    assistant_turns: int = 0
    user_turns: int = 0
    parallel: int = 1


@dataclass
class Loop:
    """``generate(messages) -> text``; tokens are what ``tokens`` cuts a text into."""

    generate: Callable[[list[dict]], str]
    tools: list[Tool] = field(default_factory=list)
    limits: Limits = field(default_factory=Limits)
    parser: str = "tagged"
    tokens: Callable[[str], list[str]] = str.split

    def run(self, conversation: str, prompt: str, truth: str) -> tuple[list[str], list[int], int, float]:
        """(response tokens, 1 for generated and 0 for tool tokens, turns, reward of the tools)."""
        limits, parse = self.limits, TOOL_PARSERS.get(self.parser)
        by_name = {t.name: t for t in self.tools}
        for tool in self.tools:
            tool.create(conversation, truth=truth)
        messages, response, mask = [{"role": "user", "content": prompt}], [], []
        asked = said = 0
        while True:
            text = self.generate(messages)
            own = self.tokens(text)
            response, mask, said = response + own, mask + [1] * len(own), said + 1
            messages.append({"role": "assistant", "content": text})
            calls = parse(text)[: limits.parallel]
            if len(mask) >= limits.response or (limits.assistant_turns and said >= limits.assistant_turns) or (limits.user_turns and asked >= limits.user_turns) or not calls:
                break
            if any(c["name"] not in by_name for c in calls):
                break
            answers = [by_name[c["name"]].execute(conversation, c.get("arguments", {}))[0] for c in calls]
            more = [w for a in answers for w in self.tokens(a)]
            if len(mask) + len(more) >= limits.response:  # the last turn is the assistant's
                break
            messages += [{"role": "tool", "content": a} for a in answers]
            response, mask, asked = response + more, mask + [0] * len(more), asked + 1
        reward = sum(t.calc_reward(conversation) for t in self.tools)
        for tool in self.tools:
            tool.release(conversation)
        return response[: limits.response], mask[: limits.response], asked + said + 1, reward


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Conversations dealt out over all tasks: their work is not in proportion to the bytes by which files are cut."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def run_loop(df: DataFrame, loop: Callable[[], Loop], key: str, prompt: str, truth: str) -> DataFrame:
    """(key, response, mask, turns, reward) of each conversation; ``loop`` makes a task's own loop with its tools."""

    def run(frames):
        machine = loop()
        for f in frames:
            rows = [machine.run(str(k), p, str(t)) for k, p, t in zip(f[key], f[prompt], f[truth])]
            yield pd.DataFrame({key: f[key], "response": [r[0] for r in rows], "mask": [r[1] for r in rows], "turns": [r[2] for r in rows], "reward": [r[3] for r in rows]})

    return dealt(df.select(key, prompt, truth), key).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, response array<string>, mask array<int>, turns int, reward double")


def interact(df: DataFrame, interaction: Callable[[], Interaction], answer: Callable[[list[dict]], str], key: str, prompt: str, truth: str, turns: int) -> DataFrame:
    """(key, turns, reward) of conversations with a simulated user, of at most ``turns`` answers."""

    def run(frames):
        user = interaction()
        for f in frames:
            out = []
            for k, p, t in zip(f[key].astype(str), f[prompt], f[truth].astype(str)):
                user.start(k, t)
                messages, n, done = [{"role": "user", "content": p}], 0, False
                while n < turns and not done:
                    messages.append({"role": "assistant", "content": answer(messages)})
                    done, said, _ = user.respond(k, messages)
                    messages.append({"role": "user", "content": said})
                    n += 1
                out.append((n, user.finalize(k)))
            yield pd.DataFrame({key: f[key], "turns": [x[0] for x in out], "reward": [x[1] for x in out]})

    return dealt(df.select(key, prompt, truth), key).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, turns int, reward double")


def load_function(spark: SparkSession, path: str, name: str, **bound) -> Callable:
    """A function of a Python file in any store that Spark reads, with keyword arguments bound; tasks get it by value."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if not rows:
        raise FileNotFoundError(path)
    module = types.ModuleType(f"loaded_{hashlib.md5(path.encode()).hexdigest()}")
    exec(compile(rows[0][0], path, "exec"), module.__dict__)  # noqa: S102  the user's own scorer
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no {name}")
    f = getattr(module, name)
    f.__module__ = "__main__"  # pickled by value

    def call(*args):
        return f(*args, **bound)

    return call


def openai_client(**settings) -> Callable[[str], str]:
    """A chat client of the openai package, where it is installed."""
    api = importlib.import_module("openai").OpenAI(**{k: v for k, v in settings.items() if k != "model"})
    return lambda prompt: api.chat.completions.create(model=settings["model"], messages=[{"role": "user", "content": prompt}]).choices[0].message.content


CLIENTS.register("openai")(openai_client)
CLIENTS.register("echo")(lambda prefix="": lambda prompt: prefix + prompt)


def reduce_groups(df: DataFrame, group: str, value: str, functions: dict[str, Callable]) -> DataFrame:
    """Python aggregates: each function takes a group's values (a series) and gives a number."""

    def aggregate(f: Callable):
        def run(s: pd.Series) -> float:
            return float(f(s))

        return F.pandas_udf(run, "double")

    return df.groupBy(group).agg(*[aggregate(f)(F.col(value)).alias(name) for name, f in functions.items()])


@AGENT_LOOPS.register("single_turn")
def single_turn(generate, **_) -> Loop:
    return Loop(generate)


@AGENT_LOOPS.register("tool_agent")
def tool_agent(generate, tools=(), **limits) -> Loop:
    return Loop(generate, list(tools), Limits(**limits))


def generate_batches(df: DataFrame, client: Callable[[list[str]], list[str]], key: str, prompt: str, samples: int, batch: int) -> DataFrame:
    """Offline generation: (columns of df, responses), ``samples`` replies for each prompt in the order of the passes.

    A task sends its prompts ``batch`` at a time, the last batch filled up with its first
    prompt, whose further replies are dropped; ``client`` takes and gives lists of a batch.
    """

    def run(prompts: pd.Series) -> pd.Series:
        texts, out = prompts.tolist(), []
        for at in range(0, len(texts), batch):
            part = texts[at : at + batch]
            full = part + part[:1] * (batch - len(part))
            passes = [client(full) for _ in range(samples)]
            out += [list(replies) for replies in zip(*passes)][: len(part)]
        return pd.Series(out)

    return df.withColumn("responses", F.pandas_udf(run, "array<string>")(prompt))
