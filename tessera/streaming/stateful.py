"""Streaming forms: step loops, batch accumulation with leftovers, running controllers, rate limits, event-time windows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_growing(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder to which files are added, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_steps(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """A step for every micro-batch; a restart goes on from the checkpoint. Ends when the input is used up."""
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def accumulate(stream: DataFrame, key: str, row: str, size: int, ts: str | None = None, idle: str = "1 hour") -> DataFrame:
    """Rows of a key in batches of ``size``, in the order of ``row`` within a micro-batch, leftovers carried: (key, batch, rows).

    With an event time ``ts`` a timer runs for each key that has leftovers: once the watermark,
    or a row of the key, is later than its last row by more than ``idle``, they come out as a
    short batch.  A row without a key only moves the watermark, so one far in the future ends
    the input (``end_of_input``).
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState):
        n, held, last = state.get if state.exists else (0, [], 0)
        held, out = list(held), []
        if state.hasTimedOut:
            out, held, n = ([(k[0], n, held)], [], n + 1) if held else ([], held, n)
            state.update((n, [], last))
        else:
            new = pd.concat(list(frames)).sort_values(row)
            if pd.isna(k[0]):
                return
            times = [0] * len(new) if ts is None else [int(x.timestamp() * 1000) for x in new[ts]]
            for value, at in zip(new[row].tolist(), times):
                if held and (len(held) == size or at - last > wait):
                    out.append((k[0], n, held))
                    held, n = [], n + 1
                held, last = [*held, value], max(last, at)
            if len(held) == size:
                out.append((k[0], n, held))
                held, n = [], n + 1
            state.update((n, held, last))
            if ts is not None and held:
                state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=[key, "batch", "rows"])

    kind = dict(stream.dtypes)
    if ts is not None:
        stream = stream.withWatermark(ts, "0 seconds")
    timer = GroupStateTimeout.NoTimeout if ts is None else GroupStateTimeout.EventTimeTimeout
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, batch long, rows array<{kind[row]}>", f"n long, held array<{kind[row]}>, last long", "append", timer)


def end_of_input(df: DataFrame, ts: str) -> DataFrame:
    """One row of the kind of ``df`` that has nothing but a time after all others."""
    end = F.lit("2200-01-01").cast(df.schema[ts].dataType)
    return df.sparkSession.range(1).select(*[end.alias(c) if c == ts else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])


class Router:
    """Sticky least-load routing: a request stays on its server while it is known, a new one goes to the server with the fewest turns in flight, the first of equals.

    At most ``most`` requests are known; beyond that the one not used for longest goes, and
    its turns in flight count no more.  A release ends a turn; of a request that is not known
    it changes nothing.
    """

    def __init__(self, servers: int, most: int, loads: list[int] | None = None, known: dict[str, tuple[int, int]] | None = None):
        self.most, self.loads, self.known = most, loads or [0] * servers, known or {}  # known: request -> (server, turns in flight), least recent first

    def take(self, request: str) -> int:
        server, turns = self.known.pop(request, (None, 0))
        if server is None:
            server = min(range(len(self.loads)), key=lambda i: (self.loads[i], i))
            if len(self.known) >= self.most:
                oldest = next(iter(self.known))
                gone, left = self.known.pop(oldest)
                self.loads[gone] -= left
        self.known[request] = server, turns + 1
        self.loads[server] += 1
        return server

    def release(self, request: str) -> int | None:
        server, turns = self.known.get(request, (None, 0))
        if server is not None and turns:
            self.known[request] = server, turns - 1
            self.loads[server] -= 1
        return server


def routed(stream: DataFrame, pool: str, order: str, request: str, release: str, servers: int, most: int = 10_000) -> DataFrame:
    """(pool, order, server) of each row of a stream of turns and releases: every pool of servers has a router, kept as state over micro-batches and restarts.

    Rows of a micro-batch are taken in their order.  Pools are dealt over tasks; the decisions
    of one pool follow each other.
    """

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState):
        loads, names, homes, turns = state.get if state.exists else (None, [], [], [])
        router = Router(servers, most, list(loads) if loads else None, dict(zip(names, zip(homes, turns))))
        rows = pd.concat(list(frames)).sort_values(order)
        chosen = [router.release(r) if end else router.take(r) for r, end in zip(rows[request], rows[release])]
        held = router.known
        state.update((router.loads, list(held), [s for s, _ in held.values()], [n for _, n in held.values()]))
        yield pd.DataFrame({pool: [k[0]] * len(rows), order: rows[order].tolist(), "server": pd.array(chosen, "Int32")})

    kind = dict(stream.dtypes)
    return stream.groupBy(pool).applyInPandasWithState(step, f"{pool} {kind[pool]}, {order} {kind[order]}, server int", "loads array<long>, names array<string>, homes array<int>, turns array<int>", "append", GroupStateTimeout.NoTimeout)


def controller(stream: DataFrame, key: str, kl: str, steps: float, target: float, horizon: float, init: float) -> DataFrame:
    """A multiplicative KL coefficient for each key, kept over micro-batches: (key, coef)."""

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState):
        coef = state.get[0] if state.exists else init
        for f in frames:
            for x in f[kl]:
                coef *= 1 + max(min(x / target - 1, 0.2), -0.2) * steps / horizon
        state.update((coef,))
        yield pd.DataFrame({key: [k[0]], "coef": [coef]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {dict(stream.dtypes)[key]}, coef double", "coef double", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, ts: str, late: str, width: str, slide: str | None = None, by: str = "event_type") -> DataFrame:
    """Event-time windows (tumbling, or sliding) behind a watermark."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w, by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")


def sessions(df: DataFrame, ts: str, gap: str, by: str) -> DataFrame:
    return df.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


class TokenBucket:
    """At most ``per_minute`` units a minute in a task; ``take`` waits."""

    def __init__(self, per_minute: float, clock=time.monotonic, sleep=time.sleep, burst: float | None = None):
        self.most = per_minute if burst is None else burst
        self.rate, self.level, self.clock, self.sleep, self.at = per_minute / 60, self.most, clock, sleep, clock()

    def take(self, units: float = 1) -> None:
        while True:
            now = self.clock()
            self.level, self.at = min(self.most, self.level + (now - self.at) * self.rate), now
            if self.level >= units - 1e-9:
                self.level -= units
                return
            self.sleep((units - self.level) / self.rate)


def throttled(df: DataFrame, key: str, at: str, order: str, per_minute: float, burst: float, units: str | None = None) -> DataFrame:
    """``df`` with ``admitted``: the second at which each request of a key, in the order of its time, passes the key's bucket. A key's requests follow each other in one task."""

    def run(pdf):
        pdf, now = pdf.sort_values([at, order]), [float(pdf[at].min())]
        bucket = TokenBucket(per_minute, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s), burst)
        out = []
        for asked, n in zip(pdf[at], pdf[units] if units else [1.0] * len(pdf)):
            now[0] = max(now[0], float(asked))
            bucket.take(n)
            out.append(now[0])
        return pdf.assign(admitted=out)

    kinds = ", ".join(f"{c} {kind}" for c, kind in df.dtypes)
    return df.groupBy(key).applyInPandas(run, f"{kinds}, admitted double")


def one_ahead(batches, generate: Callable, update: Callable) -> list:
    """A pipeline of lag one: while a batch updates the model, the next is generated with the weights of before; the results in order."""
    from concurrent.futures import ThreadPoolExecutor

    out, source = [], iter(batches)
    with ThreadPoolExecutor(max_workers=1) as pool:
        first = next(source, None)
        running = None if first is None else pool.submit(generate, first)
        while running is not None:
            done = running.result()
            following = next(source, None)
            running = None if following is None else pool.submit(generate, following)
            if running is not None:
                running.result()  # the exchange of weights waits for the generation in flight
            out.append(update(done))
    return out


def record_scores(path: str, group: str, score: str) -> Callable[[DataFrame, int], None]:
    """A step that appends each group's score total of a micro-batch to a side table, once for each batch."""

    def step(df: DataFrame, batch: int) -> None:
        sums = df.groupBy(group).agg(F.sum(score).alias("total"), F.count("*").alias("n"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return step


def curriculum(spark: SparkSession, path: str, group: str) -> DataFrame:
    """Groups with their mean score so far; the hardest (lowest) first."""
    seen = spark.read.parquet(path)
    return seen.groupBy(group).agg((F.sum("total") / F.sum("n")).alias("mean")).orderBy("mean", group)
