"""Evaluation packs: which rows, what prompt, how a reply is read and scored, and averages by several dimensions.

Packs are declared with columns and compiled together: one scan of the replies gives each
row's measures with all their dimensions (one Generate), and one grouping by (pack,
metric, dimension, key) averages them.  A pack whose unit is several rows (the steps of
a problem) first meets its steps by unit; its measures are functions of the steps' scores.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import staged


@dataclass(frozen=True)
class Dimension:
    """Keys of a breakdown: one value of a row, with ``many`` each of an array's, or none."""

    name: str
    key: Column | None = None
    many: bool = False


@dataclass(frozen=True)
class Measure:
    """An average of ``value`` (null: not counted) by each of the dimensions and overall."""

    name: str
    value: Column
    by: Sequence[Dimension] = ()


@dataclass
class Pack:
    """``answers`` are tried in order on the reply; ``score`` rates the first that gives one.

    ``measures`` make measures of the score.  With ``unit`` and ``step``, the steps of a unit
    are gathered to a map from step to score, of which ``measures`` makes them instead.
    """

    name: str
    score: Callable[[Column], Column]
    answers: Sequence[Column]
    measures: Callable[[Column], Sequence[Measure]]
    rows: Column = field(default_factory=lambda: F.lit(True))
    prompt: Column | None = None
    unit: Column | None = None
    step: Column | None = None


_ENTRY = "array<struct<pack: string, metric: string, dimension: string, key: string, value: double>>"


def _entries(pack: str, measures: Sequence[Measure]) -> Column:
    def of(m: Measure, d: Dimension) -> Column:
        row = lambda key: F.struct(F.lit(pack).alias("pack"), F.lit(m.name).alias("metric"), F.lit(d.name).alias("dimension"), key.cast("string").alias("key"), m.value.cast("double").alias("value"))
        rows = F.coalesce(F.transform(d.key, row), F.array()) if d.many else F.array(row(F.lit(None) if d.key is None else d.key))
        return rows.cast(_ENTRY)

    return F.flatten(F.array(*[of(m, d) for m in measures for d in (*m.by, Dimension("overall"))]))


def prompts(df: DataFrame, packs: Sequence[Pack]) -> DataFrame:
    """(columns of df, pack, prompt): a row for each pack that takes the row."""
    each = [F.when(p.rows, F.struct(F.lit(p.name).alias("pack"), p.prompt.alias("prompt"))) for p in packs if p.prompt is not None]
    return df.withColumn("_p", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull()))).select(*df.columns, "_p.*")


def evaluate(df: DataFrame, packs: Sequence[Pack]) -> DataFrame:
    """(pack, metric, dimension, key, value, n): averages of all packs over the replies in ``df``."""
    if len({p.name for p in packs}) < len(packs):
        raise ValueError("two packs with one name")

    def scored(own: Sequence[tuple[int, Pack]]) -> DataFrame:
        """Scores of these packs only: each reply is read once for each pack."""
        read = staged(df, {f"_a{i}": F.when(p.rows, F.coalesce(*p.answers)) for i, p in own})
        return staged(read, {f"_s{i}": F.when(p.rows, p.score(F.col(f"_a{i}")).cast("double")) for i, p in own})

    none = F.array().cast(_ENTRY)
    parts = []
    alone = [(i, p) for i, p in enumerate(packs) if p.unit is None]
    if alone:
        every = [F.when(p.rows, _entries(p.name, p.measures(F.col(f"_s{i}")))).otherwise(none) for i, p in alone]
        parts.append(scored(alone).select(F.inline(F.flatten(F.array(*every)))))
    steps = [(i, p) for i, p in enumerate(packs) if p.unit is not None]
    if steps:
        rows = [F.when(p.rows, F.struct(F.lit(i).alias("i"), p.unit.cast("string").alias("unit"), p.step.cast("string").alias("step"), F.col(f"_s{i}").alias("score"))) for i, p in steps]
        rows = scored(steps).select(F.inline(F.filter(F.array(*rows), lambda x: x.isNotNull())))
        units = rows.groupBy("i", "unit", "step").agg(F.min("score").alias("score")).groupBy("i", "unit").agg(F.map_from_entries(F.collect_list(F.struct("step", "score"))).alias("steps"))
        every = [F.when(F.col("i") == i, _entries(p.name, p.measures(F.col("steps")))).otherwise(none) for i, p in steps]
        parts.append(units.select(F.inline(F.flatten(F.array(*every)))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("value is not null").groupBy("pack", "metric", "dimension", "key").agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def mastery(parts: Sequence[str], whole: str = "multi") -> Callable[[Column], list[Measure]]:
    """Measures of a problem from the scores of its parts and of the whole.

    Generalisation is inadequate where all parts are right and the whole is wrong; knowledge
    insufficient where a part and the whole are wrong.  A right whole is mastered or learnt
    by rote: strictly, mastered only with all parts right; loosely, with any part right.
    The score takes off a half for the first, one for the second, one for rote.
    """

    def measures(steps: Column) -> list[Measure]:
        right = lambda s: F.coalesce(F.try_element_at(steps, F.lit(s)) == 1, F.lit(False))
        every, some = right(parts[0]), right(parts[0])
        for p in parts[1:]:
            every, some = every & right(p), some | right(p)
        solved = right(whole)
        one = lambda c: c.cast("double")
        out = [Measure("inadequate_generalization", one(every & ~solved)), Measure("insufficient_knowledge", one(~every & ~solved))]
        for name, known in (("strict", every), ("loose", some)):
            rote = solved & ~known
            out += [Measure(f"complete_mastery_{name}", one(solved & known)), Measure(f"rote_memorization_{name}", F.when(solved, one(rote)))]
            out.append(Measure(f"score_{name}", 1 - 0.5 * one(every & ~solved) - one(rote) - one(~every & ~solved)))
        return out

    return measures
