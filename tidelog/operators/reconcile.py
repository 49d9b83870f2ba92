"""Snapshot plus ordered change log to the target's final state, and the accounts of a replay."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.routing import buckets_for, effective_routing, shard_of

PAYLOAD = ("event_type", "value", "props")
WRITES = ("INDEX", "CREATE")


def classified(log: DataFrame) -> DataFrame:
    """The log and what each op writes: index, delete or skipped (no-ops and unknown ops)."""
    kind = F.when(F.col("op").isin(*WRITES), "index").when(F.col("op") == "DELETE", "delete").otherwise("skipped")
    return log.withColumn("write_kind", kind)


def seq_range(log: DataFrame, first: Column | int, last: Column | int) -> DataFrame:
    """Ops from first to last, both included; nothing if first > last or both are negative."""
    first, last = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    return log.where((F.col("seq_no") >= first) & (F.col("seq_no") <= last) & ~((first < 0) & (last < 0)))


def after_cutoff(log: DataFrame, cutoffs: DataFrame) -> DataFrame:
    return log.join(F.broadcast(cutoffs), "source_shard").where("seq_no > cutoff").drop("cutoff")


def final_state(ops: DataFrame, target_shards: int, keep: tuple[str, ...] = PAYLOAD) -> DataFrame:
    """The last op of every (target_shard, _id) by seq_no (ties by source shard), deletes dropped.

    One shuffle on the key with map-side partial max_by; snapshot rows are just the earliest ops.
    Ops must be transformed before, as a transform may change the key.
    """
    routed = ops.where(F.col("op") != "NO_OP").withColumn("target_shard", shard_of(effective_routing(F.col("_routing"), F.col("_id")), target_shards))
    order = F.struct("seq_no", "source_shard")
    last = routed.groupBy("target_shard", "_id").agg(F.max_by(F.struct("op", "_routing", "seq_no", *keep), order).alias("last"))
    return last.where("last.op <> 'DELETE'").select("target_shard", "_id", *(F.col(f"last.{c}") for c in ("_routing", "seq_no", *keep)))


def snapshot(log: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """What the source holds at the cutoff: the last op of (source_shard, _id) up to it, as INDEX ops with seq_no -1."""
    upto = log.join(F.broadcast(cutoffs), "source_shard").where("seq_no <= cutoff and op <> 'NO_OP'")
    last = upto.groupBy("source_shard", "_id").agg(F.max_by(F.struct("op", "_routing", *PAYLOAD), "seq_no").alias("last"))
    live = last.where("last.op <> 'DELETE'")
    return live.select("source_shard", "_id", F.lit("INDEX").alias("op"), F.lit(-1).cast("long").alias("seq_no"), "last._routing", *(f"last.{c}" for c in PAYLOAD))


COLUMNS = ("source_shard", "_id", "op", "seq_no", "_routing", *PAYLOAD)


def merged(log: DataFrame, cutoffs: DataFrame, target_shards: int, transform=None) -> DataFrame:
    """Snapshot and the ops after its cutoff, transformed op by op, folded to the final state."""
    ops = snapshot(log, cutoffs).select(*COLUMNS).unionByName(after_cutoff(log, cutoffs).select(*COLUMNS))
    return final_state(transform(ops) if transform else ops, target_shards)


def counters(log: DataFrame) -> DataFrame:
    """source_shard, applied, skipped, last_seq_no of a replayed range."""
    kinds = classified(log)
    return kinds.groupBy("source_shard").agg(F.count_if(F.col("write_kind") != "skipped").alias("applied"), F.count_if(F.col("write_kind") == "skipped").alias("skipped"), F.max("seq_no").alias("last_seq_no"))


def split_targets(deletes: DataFrame, factor: int) -> DataFrame:
    """A delete for each of the target shards that its source shard splits into."""
    return deletes.withColumn("target_shard", F.explode(F.sequence(F.col("source_shard") * factor, F.col("source_shard") * factor + factor - 1)))


def accounted(writes: DataFrame, per_op: int) -> DataFrame:
    """Of an op's writes the first counts it as applied, the last carries its seq_no; the others 0 and -1."""
    place = F.col("target_shard") - F.col("source_shard") * per_op
    return writes.withColumn("applied", F.when(place == 0, 1).otherwise(0).cast("long")).withColumn("progress_seq", F.when(place == per_op - 1, F.col("seq_no")).otherwise(-1).cast("long"))


def synthetic_keys(spark, shards: int, prefix: str = "route", rounds: int = 10, buckets: int | None = None) -> DataFrame:
    """target_shard, routing: for every shard the first candidate that hashes to it. As many rows as shards, made on the driver; an error if one is missing."""
    buckets = buckets or buckets_for(shards)
    if buckets % shards:
        raise ValueError(f"{shards} shards don't divide {buckets} buckets")
    n, found = max(20 * shards, int(shards * math.log(max(shards, 2)) * 4)), {}
    for k in range(n * rounds):
        key = f"{prefix}-{k // n}-{k % n}"
        found.setdefault(int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % buckets // (buckets // shards), key)
        if len(found) == shards:
            return spark.createDataFrame(sorted(found.items()), "target_shard long, routing string")
    raise ValueError(f"no routing key found for some of {shards} shards")


def routed_or_not(deletes: DataFrame, keys: DataFrame) -> DataFrame:
    """Deletes with the synthetic routing of their target shard; those of a shard without a key are sent once, unrouted (routing and target_shard null)."""
    # The key table has one row a shard.
    joined = deletes.join(F.broadcast(keys), "target_shard", "left").withColumn("target_shard", F.when(F.col("routing").isNotNull(), F.col("target_shard")))
    return joined.where("routing is not null").unionByName(joined.where("routing is null").dropDuplicates(["source_shard", "seq_no"]))
