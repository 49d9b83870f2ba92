"""Write control as ordered folds: estimates, batch sizes, backoff, packing, rejection kinds.

What comes next depends on the state in a way that doesn't compose, so a key's rows are folded
one after another. Rows are dealt by key, sorted by Spark (which spills), and stream through the fold
in Arrow batches: a task holds a batch and one state, however many rows a key has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START_DOC_BYTES = 10_240.0
MAX_BYTES, MIN_BYTES, MAX_DOCS = 100 << 20, 512 << 10, 500
THRESHOLD, RATIO, STEP_BYTES, COOLDOWN, REVERT = 3, 0.20, 256 << 10, 2, 0.10


class Fold:
    """The state of one key. `see` gives the row that an outcome makes, if any; `end` those after the last one."""

    def see(self, *values) -> tuple | None:
        raise NotImplementedError

    def end(self) -> list[tuple]:
        return []


def folded(df: DataFrame, key: str, order: str, columns: list[str], make: Callable[[], Fold], schema: str) -> DataFrame:
    """key and the DDL `schema`: what a fold of `columns` over each key's rows, in order, gives. With make.ordered it sees the order column too, first."""
    added = T.StructType.fromDDL(schema)
    rows = df.select(key, order, *columns).repartition(key).sortWithinPartitions(key, order)
    whole = T.StructType([rows.schema[key], *added.fields])
    ordered = getattr(make, "ordered", False)
    names, types = whole.fieldNames(), [T.DoubleType, T.LongType, T.BooleanType]
    kinds = [dict(zip(types, (pa.float64(), pa.int64(), pa.bool_())))[type(f.dataType)] for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold, kind = None, None, None

        def packed(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, *kinds])], names)

        for batch in batches:
            out, kind = [], batch.schema.types[0]
            for k, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if fold is None or k != now:
                    out += [(now, *r) for r in fold.end()] if fold else []
                    now, fold = k, make()
                row = fold.see(*values) if ordered else fold.see(*values[1:])
                if row is not None:
                    out.append((k, *row))
            yield packed(out)
        if fold:
            yield packed([(now, *r) for r in fold.end()])

    return rows.mapInArrow(run, whole)


class DocSize(Fold):
    """Bytes of a document: fast up, slow down; only where both are positive."""

    def __init__(self):
        self.old = START_DOC_BYTES

    def see(self, size, items):
        self.old = doc_size(self.old, size, items)

    def end(self):
        return [(self.old,)]


def doc_size(old: float, size: float, items: float) -> float:
    if items and size and items > 0 and size > 0:
        rate = 0.5 if size / items > old * 1.5 else 0.2
        return (1 - rate) * old + rate * (size / items)
    return old


class Throughput(Fold):
    """Bytes a millisecond, of successes: seeded by the first, then 0.7 old and 0.3 new; 0 where not measurable."""

    def __init__(self):
        self.old = 0.0

    def see(self, size, took, success):
        if success:
            now = size / took if size and took and size > 0 and took > 0 else 0.0
            self.old = now if self.old <= 0 else 0.7 * self.old + 0.3 * now

    def end(self):
        return [(self.old,)]


class Gradient(Fold):
    """Short and long running latency, samples; negative latencies don't count."""

    def __init__(self):
        self.short = self.long = 0.0
        self.samples = 0

    def see(self, v):
        if v is not None and v >= 0:
            self.short = v if not self.samples else 0.5 * v + 0.5 * self.short
            self.long = v if not self.samples else 0.1 * v + 0.9 * self.long
            self.samples += 1

    def end(self):
        return [(self.short, self.long, self.samples)]


@dataclass
class Backoff(Fold):
    """level, failures in a row, last pause (without jitter), whether `most` was reached."""

    base_ms: int = 2000
    max_ms: int = 120_000
    most: int = 50
    level: int = 0
    failures: int = 0
    pause: int = 0
    exhausted: bool = False

    def see(self, success):
        if success:
            self.level, self.failures = max(self.level - 1, 0), 0
        else:
            self.level, self.failures = self.level + 1, self.failures + 1
            self.pause = min(self.base_ms * 2 ** min(self.level - 1, 20), self.max_ms)
            self.exhausted |= self.failures >= self.most

    def end(self):
        return [(self.level, self.failures, self.pause, self.exhausted)]


def doc_sizes(df: DataFrame, key: str, order: str) -> DataFrame:
    return folded(df, key, order, ["bytes", "items"], DocSize, "state double")


def throughputs(df: DataFrame, key: str, order: str) -> DataFrame:
    return folded(df, key, order, ["bytes", "took", "success"], Throughput, "state double")


def gradients(df: DataFrame, key: str, order: str, latency: str) -> DataFrame:
    return folded(df, key, order, [latency], Gradient, "short double, long double, samples long")


def backoffs(df: DataFrame, key: str, order: str) -> DataFrame:
    return folded(df, key, order, ["success"], Backoff, "level long, failures long, pause long, exhausted boolean")


@dataclass
class Aimd(Fold):
    """Batch bytes: any failure halves; after enough successes they grow on trial, and go back if throughput falls."""

    target: int = MAX_BYTES
    doc_bytes: float = START_DOC_BYTES
    least: int = MIN_BYTES
    most: int = MAX_BYTES
    last: float = 0.0
    before: int = MAX_BYTES
    ok: int = 0
    cooldown: int = 0
    trial: bool = False
    docs: int = MAX_DOCS
    width: int = 1

    def sizes(self) -> int:
        return max(1, min(int(self.target / max(self.doc_bytes, 1.0)), self.docs))

    def most_bytes(self) -> int:
        return self.target

    def see(self, took: float, items: int, size: int, success: bool) -> None:
        self.doc_bytes = doc_size(self.doc_bytes, size, items)
        if not success:
            self.target, self.ok, self.cooldown, self.trial = max(self.target // 2, self.least), 0, COOLDOWN, False
            return
        now = size / took if size > 0 and took > 0 else 0.0
        if self.trial and self.last > 0 and now <= self.last * (1.0 - REVERT):
            self.target, self.cooldown = self.before, COOLDOWN
        self.trial = False
        self.ok += 1
        if self.cooldown:
            self.cooldown -= 1
        elif self.ok >= THRESHOLD and self.target < self.most:
            self.before = self.target
            self.target = min(self.target + max(int(self.target * RATIO), STEP_BYTES), self.most)
            self.trial, self.ok = True, 0
        self.last = now if self.last <= 0 else 0.7 * self.last + 0.3 * now


@dataclass
class Adaptive(Fold):
    """Concurrency and batch bytes by latency: shrink when the short average outruns the long one, else probe upwards."""

    target: int = MAX_BYTES
    width: int = 1
    widest: int = 8
    probe: int = 5
    limit: float = 1.5
    stable: int = 0
    short: float = 0.0
    long: float = 0.0
    samples: int = 0
    changes: dict = field(default_factory=dict)

    docs: int = MAX_DOCS

    def sizes(self) -> int:
        return self.docs

    def shrink(self) -> None:
        self.width, self.target, self.stable = max(1, self.width - 1), max(self.target // 2, MIN_BYTES), 0

    def see(self, took: float, items: int, size: int, success: bool) -> None:
        each = took / items if items > 0 else -1.0
        if each >= 0:
            self.short = each if not self.samples else 0.5 * each + 0.5 * self.short
            self.long = each if not self.samples else 0.1 * each + 0.9 * self.long
            self.samples += 1
        if not success:
            self.shrink()
        elif self.samples < 5:
            self.stable += 1
        elif (self.short / self.long if self.long > 0 else 1.0) > self.limit:
            self.shrink()
        else:
            self.stable += 1
            if self.stable >= self.probe:
                self.stable = 0
                if self.width < self.widest:
                    self.width += 1
                else:
                    self.target = min(self.target + max(int(self.target * 0.20), STEP_BYTES), MAX_BYTES)

    def most_bytes(self) -> int:
        return min(2 * self.target, MAX_BYTES)


class Traced(Fold):
    """A controller's state after each outcome."""

    def __init__(self, controller, row: Callable[[object], tuple]):
        self.controller, self.row = controller, row

    def see(self, tick, *outcome):
        self.controller.see(*outcome)
        return (tick, *self.row(self.controller))


def traced(df: DataFrame, kind: type, row: Callable[[object], tuple], schema: str) -> DataFrame:
    def make() -> Fold:
        return Traced(kind(), row)

    make.ordered = True
    return folded(df, "writer", "tick", ["took", "items", "bytes", "success"], make, f"tick long, {schema}")


def aimd_trace(df: DataFrame) -> DataFrame:
    return traced(df, Aimd, lambda c: (c.target, c.sizes(), c.cooldown, c.trial), "target long, docs long, cooldown long, trial boolean")


def adaptive_trace(df: DataFrame) -> DataFrame:
    return traced(df, Adaptive, lambda c: (c.target, c.width, c.stable, c.most_bytes()), "target long, width long, stable long, most_bytes long")


@dataclass
class Packing(Fold):
    """Greedy batches. The cap is tested before a document is added, so a batch may overshoot by one."""

    max_docs: int
    max_bytes: int
    batch: int = 0
    docs: int = 0
    held: int = 0

    def see(self, size):
        done = None
        if self.docs >= self.max_docs or self.held >= self.max_bytes:
            done = (self.batch, self.docs, self.held)
            self.batch, self.docs, self.held = self.batch + 1, 0, 0
        self.docs, self.held = self.docs + 1, self.held + size
        return done

    def end(self):
        return [(self.batch, self.docs, self.held)]


def packed(df: DataFrame, key: str, order: str, size: str, max_docs: int, max_bytes: int) -> DataFrame:
    """key, batch, docs, bytes: the batches of each key's documents in order."""
    return folded(df, key, order, [size], lambda: Packing(max_docs, max_bytes), "batch long, docs long, bytes long")


#: What an overload's message holds.
OVERLOAD_WORDS = (
    "rejected", "circuit_breaking", "too_many", "too many requests", "queue full", "releasablebytesstreamoutput", "cannot hold more than", "content-length too long",
    "content length too long", "transport content length received", "request entity too large", "in_flight_requests",
)
RANKS = {"NONE": 0, "TRANSIENT": 1, "FATAL": 2, "OVERLOAD": 3}


def rejection(status: Column, message: Column, unavailable: Column) -> Column:
    """Kind of a failed item: causes first, then the status; 409 is ignored."""
    lower = F.lower(F.coalesce(message, F.lit("")))
    told = F.lit(False)
    for w in OVERLOAD_WORDS:
        told = told | lower.contains(w)
    by_status = F.when(status == 409, "NONE").when(status == 429, "OVERLOAD").when(status.between(400, 499), "FATAL").otherwise("TRANSIENT")
    return F.when(unavailable, "TRANSIENT").when(told, "OVERLOAD").otherwise(by_status)


def overload(status: int, message: str | None) -> str:
    """rejection() of one failure."""
    if any(w in (message or "").lower() for w in OVERLOAD_WORDS):
        return "OVERLOAD"
    return {409: "NONE", 429: "OVERLOAD"}.get(status) or ("FATAL" if 400 <= status <= 499 else "TRANSIENT")


def worst(kinds: list[str]) -> str:
    """The kind of a batch: that of its worst failure."""
    return max(kinds, key=RANKS.__getitem__, default="NONE")
