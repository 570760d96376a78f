"""Length-balanced partitions: largest differencing, greedy, and token-budget micro-batches."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def largest_differencing(sizes: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """k-way partition of indices by the Karmarkar-Karp method; with ``equal`` all parts have the same number of items."""
    n = len(sizes)
    if equal and n % k:
        raise ValueError(f"{n} items do not make {k} equal parts")

    def large_first(part):
        """Sort key: greater sums first, then more items, then greater items."""
        return -part[0], -len(part[1]), [(-i, -s) for i, s in part[1]]

    def state(parts):
        parts = sorted(parts, key=large_first)
        return parts[-1][0] - parts[0][0], large_first(parts[0]), parts

    order = sorted(range(n), key=lambda i: (sizes[i], i))
    if equal:
        heap = [state([(sizes[i], [(i, sizes[i])]) for i in order[g : g + k]]) for g in range(0, n, k)]
    else:
        heap = [state([(sizes[i], [(i, sizes[i])])] + [(0, [])] * (k - 1)) for i in order]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        heapq.heappush(heap, state([(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))]))
    return [sorted(i for i, _ in p[1]) for p in heap[0][2]] if heap else [[] for _ in range(k)]


def greedy(sizes: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Items in order, each to the lightest part; with ``equal`` a bias larger than all sizes balances the counts first."""
    bias = sum(sizes) + 1 if equal else 0
    heap = [(0, p) for p in range(k)]
    parts: list[list[int]] = [[] for _ in range(k)]
    for i, s in enumerate(sizes):
        load, p = heapq.heappop(heap)
        parts[p].append(i)
        heapq.heappush(heap, (load + s + bias, p))
    if equal and any(len(p) * k != len(sizes) for p in parts):
        raise ValueError("the parts have different sizes")
    return parts


def balanced_partitions(df: DataFrame, group: str, order: str, size: str, k: int, equal: bool = False, method=largest_differencing) -> DataFrame:
    """Part number of each row of each group (a batch), one group in one worker."""
    return partitioned(df, group, order, size, lambda sizes: method(sizes, k, equal)).select(group, order, size, F.col("_part").alias("part"))


def partitioned(df: DataFrame, group: str, order: str, size: str, method: Callable[[list[int]], list[list[int]]]) -> DataFrame:
    """(group, order, size, _part, _place) by ``method``'s lists of a group's places: the number of a row's list, and its place in all of them one after another.

    Groups go to Python as arrays, many to a batch: a group of a few rows costs its own work, not a frame.
    """

    def run(groups: pd.Series) -> pd.DataFrame:
        parts, places = [], []
        for sizes in groups:
            part, place, at = [0] * len(sizes), [0] * len(sizes), 0
            for p, rows in enumerate(method([int(s) for s in sizes])):
                for i in rows:
                    part[i], place[i], at = p, at, at + 1
            parts.append(part)
            places.append(place)
        return pd.DataFrame({"part": parts, "place": places})

    row = F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("order"), F.col(size).alias("size"))
    rows = df.groupBy(group).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    found = rows.withColumn("_p", F.pandas_udf(run, "part array<long>, place array<long>")(F.transform("_rows", lambda r: r["size"].cast("long"))))
    each = found.select(group, F.inline(F.arrays_zip(F.col("_rows").alias("row"), F.col("_p.part").alias("_part"), F.col("_p.place").alias("_place"))))
    return each.select(group, F.col("row.order").alias(order), F.col("row.size").alias(size), "_part", "_place")


def microbatch_count(df: DataFrame, group: str, size: str, budget: int, least: int = 1, multiple: int = 1) -> DataFrame:
    """Micro-batches that a token budget asks for: ceil(total / budget), at most one for each row, rounded up to a multiple."""
    n = F.greatest(F.least(F.count("*"), F.ceil(F.sum(size) / budget)), F.lit(least))
    return df.groupBy(group).agg((F.ceil(n / multiple) * multiple).cast("long").alias("micro_batches"))
