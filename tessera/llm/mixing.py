"""Mixing sources to target weights by temperature.

Weights are token shares raised to an exponent between 0 and 1 and normalised.  The
exponent is found by repeated section of the interval, each round one aggregate over
the per-source totals that evaluates a grid of exponents at once, so sources are
never collected: the largest exponent whose entropy reaches ``target_entropy`` (a
share of the log of the number of sources), and the smallest one at which no source
is passed more than ``max_repeats`` times; the former wins if it also keeps the
limit, else the limit does.

The weights are realised as budgeted block permutations.  A source's documents are
dealt by hash into blocks of about ``block_docs``; every full pass takes all blocks,
each pass in a permutation of its own, and the last pass takes blocks in permuted
order up to the source's token budget, and of the block where the budget ends
each document, in hash order, that still fits.  ``mix_order`` orders all sources together,
so that every stretch of the output has about the target weights.

Defined results: a null source is a source of its own; null text has no tokens, and
documents without tokens are passed as often as the full passes of their source; a
source without tokens gets no weight and is passed once; repeated rows are documents
of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import scratch as S

GRID = 32
ROUNDS = 5


def token_count(text: str):
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def choose_exponent(totals: DataFrame, budget: float, target_entropy: float | None, max_repeats: float | None) -> float:
    """``totals`` has ``tokens`` > 0 of each source."""
    head = totals.agg(F.sum("tokens"), F.count("*"), F.min("tokens")).first()
    if not head[1]:
        return 1.0
    total, n, least = float(head[0]), head[1], float(head[2])
    share = F.col("tokens") / F.lit(total)

    def grid(low: float, high: float) -> list[tuple[float, float, float]]:
        """(exponent, entropy, passes of the smallest source) along the interval."""
        at = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        sums = totals.agg(*[F.sum(F.pow(share, F.lit(a))) for a in at], *[F.sum(F.pow(share, F.lit(a)) * F.log(share)) for a in at]).first()
        out = []
        for i, a in enumerate(at):
            z, l = sums[i], sums[GRID + 1 + i]
            out.append((a, math.log(z) - a * l / z, (least / total) ** (a - 1) / z * budget / total))
        return out

    def section(good, largest: bool) -> float:
        """Largest (smallest) exponent that is good, where good ones lie below (above) bad ones."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            points = grid(low, high)
            fine = [good(p) for p in points]
            if all(fine):
                return high if largest else low
            if not any(fine):
                return low if largest else high
            edge = fine.index(False) if largest else fine.index(True)
            low, high = points[edge - 1][0], points[edge][0]
        return low if largest else high

    exponent = 1.0
    if target_entropy is not None:
        exponent = section(lambda p: p[1] >= target_entropy * math.log(n) - 1e-12, True)
    if max_repeats is not None:
        exponent = max(exponent if target_entropy is not None else 0.0, section(lambda p: p[2] <= max_repeats + 1e-9, False))
    return round(exponent, 7)


def fitting(block: pa.Table) -> pa.Table:
    """Of a block's documents, by turn, each that fits in what the ones before it leave of ``room``."""
    block = block.sort_by([("turn", "ascending"), ("doc_id", "ascending")])
    room, keep = block.column("room")[0].as_py(), []
    for n in block.column("n_tokens").to_pylist():
        keep.append(n <= room)
        room -= n if n <= room else 0
    return block.filter(pa.array(keep))


def running(rows: DataFrame, group: str, order: list[str], size: str, scratch: S.Scratch) -> DataFrame:
    """``rows`` with ``rank`` (from 1) and ``before`` (sum of the sizes ahead) inside each group (a long), by a range sort: a group may take many tasks."""
    S.ship(rows.sparkSession)
    names = rows.columns
    sorted_rows = rows.repartitionByRange(*[F.col(c) for c in (group, *order)]).sortWithinPartitions(group, *order).withColumn("part", F.spark_partition_id())

    def run(batches):
        last, n, total = None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            g, x = b.column(names.index(group)).to_numpy(), b.column(names.index(size)).to_numpy().astype(np.int64)
            new = np.concatenate([[last is None or g[0] != last], g[1:] != g[:-1]])
            new[0] = True
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            ahead = np.cumsum(x) - x
            before, rank = ahead - ahead[first], np.arange(len(x)) - first + 1
            if g[0] == last:  # the group goes on from the batch before
                own = first == 0
                before[own] += total
                rank[own] += n
            last, n, total = g[-1], int(rank[-1]), int(before[-1] + x[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rank), pa.array(before)], names=[*b.schema.names, "own_rank", "own_before"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_rows.schema.fields)
    local = scratch.write(sorted_rows.mapInArrow(run, kinds + ", own_rank long, own_before long"), "sorted")
    parts = local.groupBy(group, "part").agg(F.count("*").alias("n"), F.sum(size).alias("total"))
    ahead = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task at most
    parts = parts.select(group, "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n"), F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("total"))
    out = local.join(S.small(scratch.write(parts, "parts")), [group, "part"])
    return out.select(*names, (F.col("own_rank") + F.col("n")).alias("rank"), (F.col("own_before") + F.col("total")).alias("before"))


def mix_sources(docs: DataFrame, *, budget_tokens: int | None = None, target_entropy: float | None = None, max_repeats: float | None = 4.0, block_docs: int = 1024, seed: int = 1) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block, mix_order, weight: a row for each pass of each document."""
    S.ship(docs.sparkSession)
    scratch = S.Scratch(docs.sparkSession)
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), token_count("text").alias("n_tokens"), F.xxhash64(F.lit(seed), "doc_id", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("h"))
    rows = scratch.write(rows.withColumn("salt", F.monotonically_increasing_id() % 256), "rows")  # written: the salt stays; it parts rows that repeat
    totals = scratch.write(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "totals")
    own = totals.where("tokens > 0")
    total = own.agg(F.sum("tokens")).first()[0] or 0
    budget = float(total if budget_tokens is None else budget_tokens)
    exponent = choose_exponent(own, budget, target_entropy, max_repeats)
    power = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(exponent))
    norm = own.agg(F.sum(power)).first()[0] or 1.0
    weight = F.when(F.col("tokens") > 0, F.round(power / F.lit(norm), 12)).otherwise(0.0)
    plan = totals.withColumn("weight", weight).withColumn("budget", F.floor(F.col("weight") * budget).cast("long"))
    plan = plan.withColumn("passes", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(1).cast("long"))).withColumn("rest", F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(F.lit(0).cast("long")))
    plan = scratch.write(plan.withColumn("blocks", F.ceil(F.col("docs") / block_docs).cast("long")).withColumnRenamed("source", "p_source"), "plan")
    placed = rows.join(S.small(plan), F.col("source").eqNullSafe(F.col("p_source"))).withColumn("block", F.pmod(F.xxhash64("h", "salt"), F.col("blocks")))
    ends = F.col("passes") + F.when(F.col("rest") > 0, 1).otherwise(0)

    def order(epoch, rank):
        return (epoch + (rank - 0.5) / F.col("blocks")) / F.greatest(ends, F.lit(1))

    block_key = F.xxhash64(F.lit(seed), "source", "block", "epoch")
    sizes = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"), F.first("passes").alias("passes"), F.first("rest").alias("rest"), F.first("blocks").alias("blocks"))
    passes = sizes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("epoch")).where((F.col("epoch") < F.col("passes")) | (F.col("rest") > 0))
    keyed = passes.withColumn("pass", F.xxhash64(F.col("source").isNull(), "source", "epoch")).withColumn("order", block_key)
    ranked = running(keyed, "pass", ["order", "block"], "size", scratch)
    ranked = ranked.where((F.col("epoch") < F.col("passes")) | (F.col("before") < F.col("rest")))
    room = F.when((F.col("epoch") < F.col("passes")) | (F.col("before") + F.col("size") <= F.col("rest")), F.lit(None)).otherwise(F.col("rest") - F.col("before"))
    ranked = scratch.write(ranked.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "epoch", "rank", room.cast("long").alias("room")), "blocks")
    out = placed.join(S.small(ranked), F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))
    whole = out.where("room is null")
    part = out.where("room is not null").withColumn("turn", F.xxhash64("h", "salt", "epoch"))
    part = part.groupBy("b_source", "block", "epoch").applyInArrow(fitting, part.schema).drop("turn")
    return whole.unionByName(part).select("doc_id", "source", "n_tokens", "epoch", "block", order(F.col("epoch"), F.col("rank")).alias("mix_order"), "weight")
