"""The convergence loop: replay rounds over a growing change log, applied idempotently to a target whose state survives the driver."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.routing import effective_routing, shard_of
from ..operators.reconcile import PAYLOAD
from ..records import Files


class NotConverging(RuntimeError):
    """More rounds than allowed."""


class Target:
    """The target as a base and the rounds after it, Parquet tables named by a pointer file; deletes are tombstones.

    A round writes the last op of each of its own keys and nothing else; reading takes the last of base and
    rounds by seq_no. So a repeated round (at-least-once delivery) changes nothing, nor do rounds that overlap the
    snapshot. After COMPACT rounds they become one, which costs what they hold; once they hold a BASE_SHARE-th of the base,
    both become the new base. A pointer is never changed but followed by the next, so a restart goes on where the last round ended.
    """

    COMPACT, BASE_SHARE = 8, 4

    def __init__(self, spark: SparkSession, path: str, shards: int, payload: tuple[str, ...] = PAYLOAD):
        self.spark, self.path, self.shards = spark, path.rstrip("/"), shards
        self.columns = ("target_shard", "_id", "source_shard", "seq_no", "op", "_routing", *payload)
        self.files = Files(spark, f"{self.path}/pointers")
        names = [n for n in self.files.names() if n.startswith("p")]
        #: base: table of the base; rounds: tables after it; rows: how many each has; applied: round ids since the base; last: seq_no by source shard.
        self.state = json.loads(self.files.read(names[-1])) if names else {"version": 0, "base": None, "rounds": [], "rows": {}, "applied": [], "last": {}}

    def point(self, **changes) -> None:
        self.state = self.state | changes | {"version": self.state["version"] + 1}
        self.files.write(f"p{self.state['version']:012d}.json", json.dumps(self.state))

    def written(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{name}")
        return name

    def read(self, *names: str) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{n}" for n in names))

    def last_ops(self, ops: DataFrame) -> DataFrame:
        rest = [c for c in self.columns if c not in ("target_shard", "_id")]
        last = ops.groupBy("target_shard", "_id").agg(F.max_by(F.struct(*rest), F.struct("seq_no", "source_shard")).alias("l"))
        return last.select("target_shard", "_id", *(F.col(f"l.{c}") for c in rest))

    def apply(self, ops: DataFrame, round_id: int | str | None = None) -> int:
        """One round; its rows. A round id that was applied is passed over."""
        if round_id is not None and round_id in self.state["applied"]:
            return 0
        routed = ops.where("op <> 'NO_OP'").withColumn("target_shard", shard_of(effective_routing(F.col("_routing"), F.col("_id")), self.shards)).select(*self.columns)
        name = self.written(self.last_ops(routed))
        table = self.read(name)
        seen = table.groupBy("source_shard").agg(F.count("*").alias("n"), F.max("seq_no").alias("last")).collect()  # one row a source shard
        n = sum(r["n"] for r in seen)
        last = dict(self.state["last"])
        for r in seen:
            last[str(r["source_shard"])] = max(last.get(str(r["source_shard"]), -1), r["last"])
        known = {"rows": self.state["rows"] | {name: n}, "last": last, "applied": [*self.state["applied"], *([] if round_id is None else [round_id])]}
        if self.state["base"] is None:
            self.point(base=name, **known)
        else:
            self.point(rounds=[*self.state["rounds"], name], **known)
            if len(self.state["rounds"]) >= self.COMPACT:
                self.compact()
        return n

    def compact(self) -> None:
        rows, rounds = self.state["rows"], self.state["rounds"]
        full = self.BASE_SHARE * sum(rows[r] for r in rounds) >= rows[self.state["base"]]
        merged = [self.state["base"], *rounds] if full else rounds
        name = self.written(self.last_ops(self.read(*merged)))
        rest = {k: v for k, v in rows.items() if k not in merged} | {name: self.read(name).count()}
        self.point(rows=rest, **({"base": name, "rounds": []} if full else {"rounds": [name]}))

    def rows(self) -> DataFrame:
        """What is live."""
        return self.last_ops(self.read(self.state["base"], *self.state["rounds"])).where("op <> 'DELETE'").drop("op", "source_shard")


def converge(log: DataFrame, target: Target, checkpoint: str) -> None:
    """Replay all of a streaming log that is there now, in as many rounds as its source deals out, and stop: the final catch-up."""
    stream = log.writeStream.foreachBatch(lambda ops, k: target.apply(ops, f"{checkpoint}#{k}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()


def gaps(log: DataFrame, last: dict[str, int]) -> DataFrame:
    """source_shard, gap: ops after the last applied one; no row where there is none."""
    known = F.create_map(*[F.lit(x) for kv in last.items() for x in (int(kv[0]), kv[1])]) if last else None
    after = F.coalesce(F.try_element_at(known, F.col("source_shard").cast("int")), F.lit(-1)) if known is not None else F.lit(-1)
    return log.where(F.col("seq_no") > after).groupBy("source_shard").agg(F.count("*").alias("gap"), F.max("seq_no").alias("last"))


def replay(read: Callable[[], DataFrame], last: dict[str, int], apply: Callable[[DataFrame, int], None], threshold: int, max_rounds: int, between: Callable[[int, int], None] = lambda rounds, gap: None) -> tuple[int, dict[str, int]]:
    """Rounds over the log as `read` gives it now, from after `last` to what was there when the round began, until no shard is more than `threshold` ops behind.

    Gives the rounds made and the last seq_no by source shard. A limit of 0 rounds is none.
    """
    rounds, last = 0, dict(last)
    while True:
        behind = gaps(read(), last).collect()  # one row a source shard
        gap = max((r["gap"] for r in behind), default=0)
        between(rounds, gap)
        if rounds and gap <= threshold or not behind:
            return rounds, last
        if max_rounds and rounds >= max_rounds:
            raise NotConverging(f"{rounds} rounds made, {max_rounds} allowed, still {gap} ops behind")
        fits = F.lit(False)
        for r in behind:
            fits = fits | ((F.col("source_shard") == r["source_shard"]) & F.col("seq_no").between(last.get(str(r["source_shard"]), -1) + 1, r["last"]))
        apply(read().where(fits), rounds)
        last |= {str(r["source_shard"]): r["last"] for r in behind}
        rounds += 1
