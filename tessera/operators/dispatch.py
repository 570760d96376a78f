"""Exchange of a batch between ranks: dispatch and collect modes, gathering, routing, balanced reordering.

A rank is a column: ``dispatch`` gives a row to each rank that gets it, ``collect``
keeps the rows of the ranks whose output counts.  Ranks of a (tensor, data, pipeline)
layout count tensor ranks fastest and pipeline ranks slowest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import balance
from tessera.operators.batch import with_pos
from tessera.plans.registry import Registry

DISPATCH_MODES = Registry("dispatch mode")


@dataclass(frozen=True)
class Layout:
    dp: int
    tp: int = 1
    pp: int = 1

    @property
    def world(self) -> int:
        return self.dp * self.tp * self.pp

    def tp_rank(self, rank: Column) -> Column:
        return rank % self.tp

    def dp_rank(self, rank: Column) -> Column:
        return F.floor(rank / self.tp) % self.dp

    def pp_rank(self, rank: Column) -> Column:
        return F.floor(rank / (self.tp * self.dp))


@dataclass(frozen=True)
class Mode:
    """``chunks``: into how many parts of equal size a batch is cut (0: it is not cut); ``takes``: which part a rank gets; ``counts``: whose output is collected."""

    chunks: Callable[[Layout], int]
    takes: Callable[[Layout, Column], Column | None]
    counts: Callable[[Layout, Column], Column]
    pads: bool = False


def add_mode(name: str, mode: Mode) -> Mode:
    return DISPATCH_MODES.register(name)(mode)


def _all(layout, rank):
    return F.lit(True)


def _last_stage(layout: Layout, rank: Column) -> Column:
    return (layout.tp_rank(rank) == 0) & (layout.pp_rank(rank) == layout.pp - 1)


for _suffix, _pads in (("", False), ("_proto", True)):
    add_mode(f"dp_compute{_suffix}", Mode(lambda l: l.world, lambda l, r: r, _all, _pads))
    add_mode(f"megatron_compute{_suffix}", Mode(lambda l: l.dp, lambda l, r: l.dp_rank(r), _last_stage, _pads))
    add_mode(f"megatron_pp_as_dp{_suffix}", Mode(lambda l: l.dp * l.pp, lambda l, r: l.dp_rank(r) * l.pp + l.pp_rank(r), lambda l, r: l.tp_rank(r) == 0, _pads))
add_mode("one_to_all", Mode(lambda l: 0, lambda l, r: None, _all))
add_mode("rank_zero", Mode(lambda l: 0, lambda l, r: None, lambda l, r: r == 0))
add_mode("megatron_pp_only", Mode(lambda l: 0, lambda l, r: None, lambda l, r: (l.tp_rank(r) == 0) & (l.dp_rank(r) == 0)))


def dispatch(df: DataFrame, mode: str, layout: Layout, pos: str = "pos") -> DataFrame:
    """``df`` (dense positions in ``pos``) with a row for each ``rank`` that gets it; a mode that pads repeats head rows, others need a size that divides."""
    m = DISPATCH_MODES.get(mode)
    ranks = F.sequence(F.lit(0), F.lit(layout.world - 1))
    k = m.chunks(layout)
    if not k:
        every = df.withColumn("rank", F.explode(ranks))
        return every.where("rank = 0") if mode == "rank_zero" else every
    n = df.count()
    if n % k and not m.pads:
        raise ValueError(f"{n} rows do not make {k} equal parts")
    if n % k:
        more = k - n % k
        head = df.withColumn(pos, F.explode(F.sequence(F.col(pos) + n, F.lit(n + more - 1).cast("long"), F.lit(n).cast("long")))) if more > n else df.where(F.col(pos) < more).withColumn(pos, F.col(pos) + n)
        df, n = df.unionByName(head.where(F.col(pos) < n + more)), n + more
    part = F.floor(F.col(pos) / (n // k))
    return df.withColumn("rank", F.explode(F.filter(ranks, lambda r: m.takes(layout, r) == part)))


def collect(df: DataFrame, mode: str, layout: Layout) -> DataFrame:
    """The rows of the ranks whose output counts."""
    return df.where(DISPATCH_MODES.get(mode).counts(layout, F.col("rank")))


def all_gather(df: DataFrame, ranks: int, rank: str = "rank") -> DataFrame:
    """Every rank's rows for every rank (``to``), to be read in order of ``rank``."""
    return df.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))


def route(df: DataFrame, request: str, order: str, servers: int) -> DataFrame:
    """Sticky routing: all turns of a request go to one server; a new request goes to the one with the fewest so far, which is the next in turn."""
    first = df.groupBy(request).agg(F.min(order).alias("_first"))
    turn = with_pos(first, "_first", request, pos="_turn").select(request, (F.col("_turn") % servers).cast("int").alias("server"))
    return df.join(turn, request)


def partition_lists(sizes: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Balanced partitions as ascending index lists; an error if a part is empty or an index is left out."""
    if len(sizes) < k:
        raise ValueError(f"{len(sizes)} items are fewer than {k} parts")
    parts = balance.largest_differencing(sizes, k, equal)
    if len(parts) != k or not all(parts) or sorted(i for p in parts for i in p) != list(range(len(sizes))):
        raise ValueError("not a partition into non-empty parts")
    return [sorted(p) for p in parts]


def balance_reorder(df: DataFrame, group: str, order: str, size: str, k: int) -> DataFrame:
    """Each group's rows (a batch) with their place after a reorder that gives ``k`` equal runs of rows similar totals: (group, order, place, rank)."""
    rows = balance.partitioned(df, group, order, size, lambda sizes: partition_lists(sizes, k, True))
    return rows.select(group, order, F.col("_place").alias("place"), F.col("_part").alias("rank"))
