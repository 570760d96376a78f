"""Curation stages of a video corpus as composites: scenes, captions, merged events, questions, filters, reasoning traces.

Models are callables on prompts (``client``); a failing call gives a null reply, and
its row is dropped or rejected as the stage says.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import choices as H
from tessera.functions import text as X
from tessera.operators import curation as C

Client = Callable[[str], str]


def detect_scenes(videos: DataFrame, key: str, length: str, scenes: Callable[[str, float], list[tuple[float, float]]], parts: int = 8) -> DataFrame:
    """(key, start, end) of the scenes of videos with a positive length, in order; where the detector finds none, ``parts`` equal ranges."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(k, float(a), float(b)) for k, n in zip(f[key], f[length]) for a, b in (scenes(k, n) or [(i * n / parts, n - 1 if i == parts - 1 else (i + 1) * n / parts) for i in range(parts)])]
            yield pd.DataFrame(rows, columns=[key, "start", "end"])

    found = videos.where(F.col(length) > 0).select(key, F.col(length).cast("double").alias(length)).mapInPandas(run, f"{key} {dict(videos.dtypes)[key]}, start double, end double")
    return found.orderBy(key, "start")


def clip_captions(segments: DataFrame, key: str, client: Client, width: int = 10) -> DataFrame:
    """(key, start, end, caption) of windows of at most ``width`` seconds; clips whose call fails are dropped."""
    clips = C.split_windows(segments.select(key, "start", "end"), "start", "end", width)
    asked = C.pipeline_call(clips.withColumn("_p", F.format_string("%s %.1f-%.1f", F.col(key).cast("string"), "start", "end")), client, "_p", "caption")
    return asked.where("caption is not null").drop("_p").orderBy(key, "start")


def merge_events(captions: DataFrame, key: str, client: Client) -> DataFrame:
    """(key, event, captions): neighbouring captions that a yes-or-no judge holds for one event."""
    same = lambda a, b: "yes" in (client(f"{a}\n{b}") or "").lower()
    return C.merge_adjacent(captions, key, "start", "caption", same)


def merge_captions(events: DataFrame, keys: list[str], captions: str, client: Client) -> DataFrame:
    """One caption for each event: of one caption itself, of two their merge, of more a tree of merges."""

    def fold(texts) -> str | None:
        texts = list(texts)
        while len(texts) > 1:
            texts = [client(f"{a}\n{b}") for a, b in zip(texts[::2], texts[1::2])] + texts[len(texts) - len(texts) % 2 :]
        return texts[0] if texts else None

    return events.select(*keys, F.pandas_udf(lambda s: s.map(fold), "string")(captions).alias("caption"))


def generate_questions(captions: DataFrame, key: str, client: Client, size: int, price: float, done: DataFrame | None = None) -> DataFrame:
    """(key, group_id, question, answer, cost) from groups of ``size`` captions of the keys that are not done; replies without a question or an answer are rejected."""
    rest = captions if done is None else C.unprocessed(captions, done, key)
    groups = C.merge_groups(C.group_captions(rest, key, ["start"], size), [key, "group_id"], ["start"], "caption", "start", "end")
    asked = C.pipeline_call(groups, client, "merged", "reply").withColumn("qa", F.from_json("reply", "question string, answer string"))
    tokens = F.size(F.split("merged", r"\s+")) + F.size(F.split("reply", r"\s+"))
    return asked.where("qa.question <> '' and qa.answer <> ''").select(key, "group_id", "qa.question", "qa.answer", F.round(tokens / 1000 * price, 9).alias("cost"))


def select_questions(questions: DataFrame, summaries: DataFrame, key: str, item: str, client: Client) -> DataFrame:
    """Questions that a client picks from a video's list, with their 1-based rank; videos without a summary are left out."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(item).alias("i"), "question")))
    lists = questions.join(summaries.where("summary <> ''").select(key, "summary"), key).groupBy(key).agg(rows.alias("x"), F.first("summary").alias("summary"))
    prompt = F.concat("summary", F.lit("\n"), F.array_join(F.transform("x", lambda e: F.concat(e["i"].cast("string"), F.lit(": "), e["question"])), "\n"))
    picked = C.pipeline_call(lists.withColumn("_p", prompt), client, "_p", "reply")
    ids = F.filter(F.transform(F.regexp_extract_all("reply", F.lit(r"\d+"), 0), lambda v: v.try_cast("bigint")), lambda v: v.isNotNull())
    return C.attach_rank(questions, picked.select(key, F.array_distinct(ids).alias("_ids")), key, "_ids", item)


def filter_by_view(questions: DataFrame, index: DataFrame, name: str, client: Client, least: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(questions that pass, funnel): valid ones whose video file is found are shown to a client, whose score must reach ``least``; no score does not pass."""
    valid = questions.where("question <> '' and answer <> ''")
    found = C.fallback_lookup(valid, index, name)
    asked = C.pipeline_call(found.withColumn("_p", F.when(F.col("path").isNotNull(), F.concat_ws("\n", "path", "question", "answer"))), client, "_p", "reply")
    scored = asked.withColumn("score", X.judge_score(F.col("reply"))).drop("_p")
    count = lambda c: F.count_if(c).alias
    passed = F.col("score") >= least
    funnel = scored.agg(F.count("*").alias("valid"), count(F.col("path").isNotNull())("found"), count(F.col("score").isNotNull())("evaluated"), count(passed)("passed"))
    return scored.where(passed), funnel


def reasoning_traces(questions: DataFrame, name: str, seconds: str, client: Client, frames: int = 8, rounds: Column | None = None) -> DataFrame:
    """(.., rounds, frames, think) for valid questions: rounds by length, frames sampled evenly, a prompt, and the reply's thought; replies without one are left out."""
    told = questions.where("question <> '' and answer <> ''").withColumn("rounds", H.rounds_for(F.col(name), F.col(seconds)) if rounds is None else rounds)
    told = told.withColumn("frames", X.uniform_frames(F.greatest(F.floor(F.col(seconds)), F.lit(1)), frames))
    prompt = F.format_string("%s\nframes %s\nrounds %d", "question", F.array_join(F.col("frames").cast("array<string>"), ","), "rounds")
    asked = C.pipeline_call(told.withColumn("_p", prompt), client, "_p", "reply")
    return asked.withColumn("think", H.strip(F.regexp_extract("reply", r"(?s)<think>(.*?)</think>", 1))).where("think <> ''").drop("_p", "reply")


def summarize(captions: DataFrame, key: str, start: str, end: str, caption: str, client: Client, longest: int = 100_000) -> DataFrame:
    """(key, summary, segments, groups) of each video: event lines, sorted by their times.

    Consecutive captions form groups of an adaptive size; a call for each group gives its
    event lines, and calls on pairs of neighbouring blocks, round after round, merge them
    until one is left (an odd block is carried on).  Prompts are cut in the middle beyond
    ``longest`` characters; a failing call leaves an empty block.  Each round is one call
    column and one grouping, so the blocks of a video are dealt over tasks.
    """
    line = F.format_string("Video_event %d [%.1fs - %.1fs]: %s", F.row_number().over(Window.partitionBy(key).orderBy(start, end, caption)), F.col(start).cast("double"), F.col(end).cast("double"), F.col(caption))
    rows = C.group_captions(captions.select(key, F.col(start).alias("_start"), F.col(end).alias("_end"), line.alias("_line")), key, ["_start", "_end", "_line"])
    groups = C.merge_groups(rows, [key, "group_id"], ["_start", "_end"], "_line", "_start", "_end")
    counts = groups.groupBy(key).agg(F.sum("segments").alias("segments"), F.count("*").alias("groups"))
    lines = lambda reply: F.array_join(H.sorted_event_lines(F.coalesce(reply, F.lit(""))), "\n")
    asked = C.pipeline_call(groups.withColumn("_p", F.concat(F.lit("Summarize.\n---\n"), X.truncate(F.col("merged"), longest, "middle"))), client, "_p", "_reply")
    blocks = asked.select(key, F.col("group_id").alias("i"), lines(F.col("_reply")).alias("block"))
    rounds = max(0, math.ceil(math.log2(counts.agg(F.max("groups")).first()[0] or 1)))
    for _ in range(rounds):
        pairs = blocks.groupBy(key, F.floor(F.col("i") / 2).alias("i")).agg(F.sort_array(F.collect_list(F.struct(F.col("i").alias("o"), "block"))).alias("x"))
        prompt = F.when(F.size("x") == 2, F.concat(F.lit("Merge.\n(Sequence A)\n"), F.col("x")[0]["block"], F.lit("\n---\n(Sequence B)\n"), F.get("x", F.lit(1))["block"]))
        asked = C.pipeline_call(X.staged(pairs, {"_p": prompt}), client, "_p", "_reply")
        blocks = X.staged(asked, {"block": F.when(F.size("x") == 2, lines(F.col("_reply"))).otherwise(F.col("x")[0]["block"])}).select(key, "i", "block")
    return blocks.join(counts, key).select(key, F.col("block").alias("summary"), "segments", "groups")
