"""Exact nearest vectors of many queries: blocks of queries against blocks of vectors, as matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Scores that a task holds at a time.
SCORES = 4_000_000


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of a row's ``k`` best scores, equal ones by id; missing scores last and never taken."""
    least = np.partition(scores, len(scores) - k)[len(scores) - k] if k < len(scores) else -np.inf
    at = np.flatnonzero((scores >= least) & np.isfinite(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def vector_topk(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, digits: int = 6, block: int = 1 << 16) -> DataFrame:
    """(query, neighbour, score, rank): of each query the ``k`` vectors with the largest cosine, rounded to ``digits``; equal ones by key.

    Vectors are dealt into blocks of about ``block`` rows.  A task gathers one block as a
    matrix and multiplies it with the queries as they stream by, keeping each query's k best
    of the block; those meet by query.  Queries travel once for each block, vectors once.
    Rows without a key or a vector, vectors of another length than the longest and vectors
    of zeros take no part.
    """
    kind = dict(vectors.dtypes)[key]
    if kind not in ("int", "bigint"):
        raise ValueError("keys must be whole numbers")
    held = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    about = held.agg(F.count("*"), F.max(F.size(vector))).first()
    blocks, dim = max(1, -(-about[0] // block)), about[1] or 0
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    usable = lambda df: df.where(F.col(key).isNotNull() & (F.size(vector) == dim)).withColumn("_norm", norm).where(F.col("_norm") > 0)
    shape = lambda df, b, side: df.select(b.alias("block"), F.lit(side).alias("side"), F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double") / F.col("_norm")).alias("v"))
    left = shape(usable(vectors), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), 0)
    right = shape(usable(queries), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), 1)

    def run(batches):
        at, ids, rows, matrix = None, [], [], None
        for batch in batches:
            b, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(b) != 0) | (np.diff(side) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(b)]):
                part = batch.slice(low, high - low)
                if b[low] != at:
                    at, ids, rows, matrix = b[low], [], [], None
                i, m = part.column(2).to_numpy(), _matrix(part.column(3), dim)
                if side[low] == 0:
                    ids.append(i)
                    rows.append(m)
                    continue
                if not rows:
                    continue
                if matrix is None:
                    ids, matrix = np.concatenate(ids), np.concatenate(rows)
                step = max(1, SCORES // len(ids))
                for first in range(0, len(i), step):
                    scores = np.round(m[first : first + step] @ matrix.T, digits)
                    best = [best_of(s, ids, k) for s in scores]
                    taken = np.concatenate(best)
                    owner = np.repeat(np.arange(len(best)), [len(x) for x in best])
                    yield pa.RecordBatch.from_arrays([pa.array(i[first : first + step][owner]), pa.array(ids[taken]), pa.array(scores[owner, taken])], names=["query", "neighbour", "score"])

    near = left.unionByName(right).repartition("block").sortWithinPartitions("block", "side").mapInArrow(run, "query long, neighbour long, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "neighbour")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
