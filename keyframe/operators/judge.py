"""Judges stand in for model calls: a judge answers a batch of (key, prompt) rows. Real clients plug in by the same
function; HashJudge is deterministic. Replies are kept in a table by the prompt's digest, and only misses are asked."""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Judge = Callable[[list[str]], list[str]]


def hash_judge(prompts: list[str]) -> list[str]:
    """A letter from A to E by the prompt's checksum."""
    return ["ABCDE"[zlib.crc32(p.encode()) % 5] for p in prompts]


def with_retry(judge: Judge, tries: int = 3, wait: float = 0.0) -> Judge:
    """Ask again on failure, after ``wait`` seconds more each time. Prompts whose batch goes on failing are asked once more, one
    by one, so that only a prompt that fails by itself has an empty reply: a failed call must not stop the run."""

    def alone(prompt: str) -> str:
        try:
            return judge([prompt])[0]
        except Exception:  # noqa: BLE001
            return ""

    def ask(prompts: list[str]) -> list[str]:
        for k in range(tries):
            try:
                return judge(prompts)
            except Exception:  # noqa: BLE001  a client may raise anything
                if k + 1 < tries:
                    time.sleep(wait * (k + 1))
        return [""] if len(prompts) == 1 else [alone(p) for p in prompts]

    return ask


def in_order(work: Iterator, call: Callable, running: int) -> Iterator:
    """(item, call(item)) of all items in their order, ``running`` calls at a time; an item is taken only when there is room."""
    from collections import deque
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(running) as pool:
        waiting: deque = deque()
        for item in work:
            waiting.append((item, pool.submit(call, item)))
            if len(waiting) >= running:
                first, reply = waiting.popleft()
                yield first, reply.result()
        while waiting:
            first, reply = waiting.popleft()
            yield first, reply.result()


def until_read(judge: Judge, reads: Callable[[str], bool], tries: int = 5) -> Judge:
    """Ask again for the replies that don't read, ``tries`` times in all; the last reply stands."""

    def ask(prompts: list[str]) -> list[str]:
        replies = judge(prompts)
        for _ in range(tries - 1):
            bad = [i for i, r in enumerate(replies) if not reads(r)]
            if not bad:
                break
            for i, r in zip(bad, judge([prompts[i] for i in bad])):
                replies[i] = r
        return replies

    return ask


_CLIENTS: dict = {}


def per_worker(name: str, make: Callable[[], Judge]) -> Judge:
    """A judge whose client is made once in each worker, on first use, and kept under ``name``; settings belong to the name,
    so that two callers with unlike settings use two names."""

    def ask(prompts: list[str]) -> list[str]:
        if name not in _CLIENTS:
            _CLIENTS[name] = make()
        return _CLIENTS[name](prompts)

    return ask


#: What a judge is asked for in each of its roles; {names} are columns.
ROLES = {
    "summary": "Sum up what these captions show: {narration}",
    "summary_qa": "Using this summary, choose the option that answers the question. Summary: {summary} Question: {question}",
    "steps": "Think step by step about the frames and choose an option. Question: {question}",
    "direct": "Answer with the number of one option only. Question: {question}",
    "self_check": "How sure is this answer, from 1 (not) to 3 (very)? Question: {question} Answer: {answer}",
    "relevance": "Does this frame show what is asked about? Reply yes or no. Goal: {goal}",
    "missing": "Which part of the video should be looked at more closely? Question: {question} Segments: {segments}",
}


def prompt_of(role: str, **columns: Column) -> Column:
    """The prompt of a role, its names filled in from columns."""
    parts = re.split(r"\{(\w+)\}", ROLES[role])
    return F.concat(*(F.coalesce(columns[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def ask(rows: DataFrame, judge: Judge = hash_judge, prompt: str = "prompt", batch: int = 32, running: int = 8, tries: int = 3, wait: float = 0.0) -> DataFrame:
    """``rows`` with the column reply, in their order within a partition. Calls have ``batch`` prompts; a task has ``running`` of
    them under way and takes further rows only as these come back."""
    asked = with_retry(judge, tries, wait)
    schema = rows.withColumn("reply", F.lit("")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = (f.iloc[k : k + batch] for f in frames for k in range(0, len(f), batch))
        for part, replies in in_order(parts, lambda p: asked(p[prompt].tolist()), running):
            yield part.assign(reply=replies)

    return rows.mapInPandas(run, schema)


def cached(rows: DataFrame, cache: DataFrame, judge: Judge = hash_judge, prompt: str = "prompt", store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with replies, new cache rows). ``cache``: key, reply; of a key that repeats in it one reply counts. Equal prompts
    are asked once in a plan.

    The new rows are written to ``store`` and read back, so that both results have the same replies and the judge is
    asked once for both; without a ``store`` only one of the two results may be used, as each runs the judge."""
    keyed = rows.withColumn("key", F.sha2(prompt, 256))
    misses = keyed.select("key", prompt).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    new = ask(misses, judge, prompt).select("key", "reply")
    if store:
        new.write.mode("overwrite").parquet(store)
        new = rows.sparkSession.read.schema(new.schema).parquet(store)
    known = cache.groupBy("key").agg(F.min("reply").alias("reply"))
    return keyed.join(known.unionByName(new), "key", "left").drop("key"), new
