"""Training rows of token arrays: loss masks, preference batches, reward-model pairs, nested values as lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.batch import with_pos


def sft_loss_mask(mask: Column, prompt: Column) -> Column:
    """A row's attention mask without its prompt tokens and its last valid token, which predicts nothing."""
    end = F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int"))
    return F.transform(mask, lambda m, i: F.when((i < F.least(prompt, F.size(mask)) - 1) | (i == end - 1), 0).otherwise(m.cast("int")))


def turn_masks(messages: Column) -> Column:
    """(role, tokens, loss mask) of each run of a conversation: tool messages in a row are one; only an assistant's own tokens count, not the ``prompt`` ones that announce it.

    ``messages``: structs of role, prompt (tokens of the generation prompt) and tokens.
    """

    def join(s: Column, m: Column) -> Column:
        own = F.when(m["role"] == "assistant", F.concat(F.transform(m["prompt"], lambda _: F.lit(0)), F.transform(m["tokens"], lambda _: F.lit(1))))
        tokens = F.when(m["role"] == "assistant", F.concat(m["prompt"], m["tokens"])).otherwise(m["tokens"])
        mask = F.coalesce(own, F.transform(m["tokens"], lambda _: F.lit(0)))
        tail = F.try_element_at(s, F.lit(-1))
        more = F.struct(m["role"].alias("role"), F.concat(tail["tokens"], tokens).alias("tokens"), F.concat(tail["mask"], mask).alias("mask"))
        new = F.struct(m["role"].alias("role"), tokens.alias("tokens"), mask.alias("mask"))
        grouped = (m["role"] == "tool") & F.coalesce(tail["role"] == "tool", F.lit(False))
        return F.when(grouped, F.concat(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.array(more))).otherwise(F.concat(s, F.array(new)))

    return F.aggregate(messages, F.array().cast("array<struct<role:string,tokens:array<int>,mask:array<int>>>"), join)


def fit_length(ids: Column, length: int) -> tuple[Column, Column]:
    """(ids, attention mask) cut on the right or filled with zeros to ``length``."""
    short = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    zeros = F.array_repeat(F.lit(0), short)
    return F.concat(F.slice(ids, 1, length), zeros), F.concat(F.transform(F.slice(ids, 1, length), lambda _: F.lit(1)), zeros)


def reward_pairs(df: DataFrame, prompt: str, chosen: str, rejected: str, length: int, eos: int | None = None) -> DataFrame:
    """Chosen and rejected sequences (prompt, answer, end token) of one length, stacked: ``input_ids`` and ``attention_mask`` are arrays of two rows."""
    end = F.array(F.lit(eos)) if eos is not None else F.array().cast("array<int>")
    both = [fit_length(F.concat(F.col(prompt), F.col(c), end), length) for c in (chosen, rejected)]
    return df.withColumn("input_ids", F.array(*[ids for ids, _ in both])).withColumn("attention_mask", F.array(*[mask for _, mask in both]))


def preference_batch(df: DataFrame, preferred: str, order: str, ids: str, prompt_length: int, logps: str | None = None, response: str | None = None) -> DataFrame:
    """Rows split by the mask ``preferred`` and joined place by place: chosen_* and rejected_* ids, labels (-100 on the prompt) and reference log-probabilities of the response."""
    labels = F.transform(F.col(ids), lambda x, i: F.when(i < prompt_length, -100).otherwise(x))
    total = F.aggregate(F.zip_with(F.col(logps), F.col(response), lambda a, m: a * m), F.lit(0.0), lambda a, x: a + x) if logps else F.lit(None).cast("double")
    rows = df.select(order, preferred, F.col(ids).alias("ids"), labels.alias("labels"), total.alias("logp"))

    def side(name: str, mask: Column) -> DataFrame:
        placed = with_pos(rows.where(mask), order, pos="pair")
        return placed.select("pair", *[F.col(c).alias(f"{name}_{c}") for c in (order, "ids", "labels", "logp")])

    return side("chosen", F.col(preferred)).join(side("rejected", ~F.col(preferred)), "pair")


def as_lists(kind: T.DataType, value: Column) -> Column:
    """A nested value with every map and struct inside arrays and structs kept, and every array a plain list of converted elements."""
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: as_lists(kind.elementType, x))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[as_lists(f.dataType, value[f.name]).alias(f.name) for f in kind.fields]))
    return value
