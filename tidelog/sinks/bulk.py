"""Rows to an outside store in bulk requests: sized by a controller, retried from the head of the queue, slowed down on overload.

A partition is written by one task. A replay's target shards each lie in one partition, and are
written one after another, in order of seq_no, with one request under way at a time; a backfill may
have several partitions a shard and several requests. A task that Spark runs again sends its rows again, so the
store's writes must be idempotent by id.
"""

from __future__ import annotations

import random
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.control import Adaptive, Aimd, overload, worst
from ..settings import Settings

#: Sends rows; gives for each None, or (status, message) of its failure.
Send = Callable[[list], list]


class Exhausted(RuntimeError):
    """Too many failures in a row, or one that no retry mends."""


@dataclass
class Fixed:
    """Batches of the same number of rows."""

    docs: int
    width: int = 1

    def sizes(self) -> int:
        return self.docs

    def most_bytes(self) -> float:
        return float("inf")

    def see(self, took: float, items: int, size: int, success: bool) -> None:
        pass


def controller(settings: Settings, replay: bool):
    kind = settings.replay_controller if replay else settings.backfill_controller
    if kind == "fixed":
        return Fixed(settings.fixed_batch_docs, 1 if replay else settings.backfill_concurrency)
    if kind == "adaptive_batch":
        return Aimd(target=settings.batch_max_bytes, doc_bytes=float(settings.start_doc_bytes), least=settings.batch_min_bytes, most=settings.batch_max_bytes, before=settings.batch_max_bytes, docs=settings.batch_max_docs, width=1 if replay else settings.backfill_concurrency)
    return Adaptive(target=settings.batch_max_bytes, widest=settings.adaptive_max_concurrency, probe=settings.adaptive_probe, limit=settings.adaptive_gradient)


class Queue:
    """What is left to send. Rows that failed go to the head, in the order they had."""

    def __init__(self, rows: Iterable):
        self.rows, self.again = iter(rows), deque()
        self.taken = 0

    def requeue(self, rows: list[tuple[int, object]]) -> None:
        self.again = deque(sorted([*self.again, *rows], key=lambda r: r[0]))

    def batch(self, docs: int, most_bytes: float, size: Callable[[object], int]) -> list[tuple[int, object]]:
        """Up to `docs` rows; the cap of bytes is tested before a row is added, so a batch may overshoot by one."""
        out, held = [], 0
        while len(out) < docs and held < most_bytes:
            if self.again:
                row = self.again.popleft()
            else:
                try:
                    row = (self.taken, next(self.rows))
                except StopIteration:
                    break
                self.taken += 1
            out.append(row)
            held += size(row[1])
        return out


@dataclass
class Writer:
    """Writes one partition."""

    send: Send
    settings: Settings = field(default_factory=Settings)
    replay: bool = False
    size: Callable[[object], int] = lambda row: len(str(row))
    sleep: Callable[[float], None] = time.sleep
    random: Callable[[], float] = random.random

    def write(self, rows: Iterable) -> dict:
        """sent, requests, retried, paused_ms."""
        control, queue = controller(self.settings, self.replay), Queue(rows)
        told = {"sent": 0, "requests": 0, "retried": 0, "paused_ms": 0}
        level = failures = 0
        under_way: dict = {}
        with ThreadPoolExecutor(max(1, self.settings.adaptive_max_concurrency, self.settings.backfill_concurrency)) as pool:
            while True:
                while len(under_way) < (1 if self.replay else control.width):
                    batch = queue.batch(control.sizes(), control.most_bytes(), self.size)
                    if not batch:
                        break
                    under_way[pool.submit(self.timed, [r for _, r in batch])] = batch
                if not under_way:
                    return told  # nothing is left, and nothing can come back
                done, _ = wait(under_way, return_when=FIRST_COMPLETED)
                for f in done:
                    batch, (took, results) = under_way.pop(f), f.result()
                    failed = [(row, r) for row, r in zip(batch, results) if r is not None and r[0] != 409]
                    kind = worst([overload(status, message) for _, (status, message) in failed])
                    told["requests"] += 1
                    told["sent"] += len(batch) - len(failed)
                    control.see(took, len(batch), sum(self.size(r) for _, r in batch), kind != "OVERLOAD")
                    if kind == "FATAL":
                        raise Exhausted(f"not to be retried: {next(r for _, r in failed if overload(*r) == 'FATAL')}")
                    if kind == "NONE":
                        level, failures = max(0, level - 1), 0
                        continue
                    level, failures = level + 1, failures + 1
                    told["retried"] += len(failed)
                    queue.requeue([row for row, _ in failed])
                    if failures >= self.settings.overload_max_failures:
                        raise Exhausted(f"{failures} requests failed in a row: {failed[0][1]}")
                    pause = min(self.settings.overload_base_ms * 2 ** min(level - 1, 20), self.settings.overload_max_pause_ms)
                    pause += int(pause * 0.25 * self.random())
                    told["paused_ms"] += pause
                    self.sleep(pause / 1000)

    def timed(self, rows: list) -> tuple[float, list]:
        began = time.monotonic()
        try:
            results = self.send(rows)
        except Exception as e:  # the request itself: all of its rows
            results = [(503, str(e))] * len(rows)
        return (time.monotonic() - began) * 1000, results


def write(df: DataFrame, connect: Callable[[], Send], settings: Settings | None = None, replay: bool = False, parts: int | None = None) -> DataFrame:
    """Write df (target_shard, seq_no, ...); `connect` makes a task's own sender. Gives what each writer tells. Nothing is sent before the result is read."""
    settings = settings or Settings()
    if replay:
        dealt = df.repartition(*([parts] if parts else []), "target_shard").sortWithinPartitions("target_shard", "seq_no")
    else:
        dealt = df.repartition(parts) if parts else df

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        rows = (row for frame in batches for row in frame.to_dict("records"))
        send = connect()
        for _, some in groupby(rows, lambda r: r["target_shard"]) if replay else [(None, rows)]:
            yield pd.DataFrame([Writer(send, settings, replay).write(some)])

    return dealt.mapInPandas(run, "sent long, requests long, retried long, paused_ms long")


def unsent(results: DataFrame) -> DataFrame:
    """Totals over all writers."""
    return results.agg(*(F.sum(c).alias(c) for c in results.columns))
