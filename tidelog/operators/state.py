"""Status, listing, phases, gates, liveness, leases and clean-up as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.fixtures import COORDINATOR_PHASES, SHARD_PHASES, TERMINAL

#: What the filter word ACTIVE stands for, and the shard phases of the happy path.
ACTIVE = ("ACTIVE", "INITIALIZING", "CUTTING_OVER", "CATCHING_UP", "COMPLETING", "CANCELLING", "FAILING")
HAPPY_PATH = SHARD_PHASES[:9]
MOST, USUAL = 500, 50


def wanted_phases(status: str | None) -> tuple[str, ...] | None:
    """None for all; a comma list else, trimmed, in any case. Blank lists, empty and unknown words are errors."""
    if status is None:
        return ACTIVE
    if status.strip().lower() == "all":
        return None
    out: list[str] = []
    for word in status.split(","):
        word = word.strip().upper()
        if not word:
            raise ValueError(f"status has an empty word: {status!r}")
        if word != "ACTIVE" and word not in COORDINATOR_PHASES:
            raise ValueError(f"unknown status {word!r}")
        out += ACTIVE if word == "ACTIVE" else (word,)
    return tuple(dict.fromkeys(out))


def size_of(size: int | None) -> int:
    if size is not None and size <= 0:
        raise ValueError("size must be positive")
    return min(size or USUAL, MOST)


def listed(migrations: DataFrame, status: str | None, size: int | None) -> DataFrame:
    """Newest first; each row tells whether there are more and how many are not terminal. Only the page and two counts leave the executors."""
    phases = wanted_phases(status)
    fits = F.lit(True) if phases is None else F.col("phase").isin(*phases)
    n = size_of(size)
    page = migrations.where(fits).orderBy(F.desc("start_ms"), "migration_id").limit(n)
    counts = migrations.agg((F.count_if(fits) > n).alias("truncated"), F.count_if(~F.col("phase").isin(*TERMINAL)).alias("active_count"))
    # counts is one row.
    return page.crossJoin(F.broadcast(counts))


def overlaid(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored rows that aren't terminal give way to the live one of their source; live rows of no such source are added."""
    new = live.select(F.col("source_index"), F.struct(*[c for c in live.columns if c != "source_index"]).alias("__live"))
    rest = [c for c in stored.columns if c != "source_index"]
    # One live row a source: a source has one active migration.
    both = stored.join(new, "source_index", "left")
    replaced = F.col("__live").isNotNull() & ~F.col("phase").isin(*TERMINAL)
    seen = both.where(replaced).select("source_index").distinct()
    old = both.select("source_index", *(F.when(replaced, F.col(f"__live.{c}")).otherwise(F.col(c)).alias(c) for c in rest))
    return old.unionByName(live.join(seen, "source_index", "left_anti").select(*old.columns))


def elapsed_seconds(start: Column, updated: Column) -> Column:
    return F.when((start <= 0) | (updated < start), F.lit(0)).otherwise(F.floor((updated - start) / 1000)).cast("long")


def summaries(migrations: DataFrame, shards: DataFrame) -> DataFrame:
    counts = shards.where("phase is not null").groupBy("migration_id").agg(F.count("*").alias("shard_count"))
    joined = migrations.join(counts, "migration_id", "left")
    return joined.select("migration_id", "source_index", "phase", F.col("phase").isin(*TERMINAL).alias("is_terminal"), F.coalesce("shard_count", F.lit(0)).cast("long").alias("shard_count"), elapsed_seconds(F.col("start_ms"), F.col("updated_ms")).alias("elapsed_seconds"))


def beyond(phase: Column, target: str) -> Column:
    """Whether the phase is the target or later on the happy path; others aren't on it."""
    path = F.array(*map(F.lit, HAPPY_PATH))
    return F.coalesce(F.array_position(path, phase) >= HAPPY_PATH.index(target) + 1, F.lit(False))


def allowed(before: Column, after: Column) -> Column:
    """The shard machine's moves: the next phase of the path, cancel or fail from any phase that isn't terminal, and their ends."""
    path = F.array(*map(F.lit, HAPPY_PATH))
    at = lambda p: F.array_position(path, p)
    step = (at(before) > 0) & (at(after) == at(before) + 1)
    stop = after.isin("CANCELLING", "FAILING") & ~before.isin(*TERMINAL)
    end = ((before == "CANCELLING") & (after == "CANCELLED")) | ((before == "FAILING") & (after == "FAILED"))
    return step | stop | end


def may_move(before: str, after: str) -> bool:
    """allowed() for two phases."""
    step = before in HAPPY_PATH and after in HAPPY_PATH and HAPPY_PATH.index(after) == HAPPY_PATH.index(before) + 1
    return step or after in ("CANCELLING", "FAILING") and before not in TERMINAL or (before, after) in (("CANCELLING", "CANCELLED"), ("FAILING", "FAILED"))


def consistency(nodes: DataFrame) -> DataFrame:
    """One row: versions, missing, consistent. nodes: node, version (null: without the engine)."""
    return nodes.agg(F.countDistinct("version").alias("versions"), F.count_if(F.col("version").isNull()).alias("missing")).withColumn("consistent", (F.col("versions") <= 1) & (F.col("missing") == 0))


#: Fixed value: the first host version whose logged deletes carry their routing, as 1000 * major + minor.
ROUTED_DELETES = 3009


def delete_strategy(versions: DataFrame) -> str:
    """By the oldest host of versions (major, minor)."""
    oldest = versions.agg(F.min(F.col("major") * 1000 + F.col("minor"))).first()[0]
    return "TRANSLOG_ROUTING" if oldest is not None and oldest >= ROUTED_DELETES else "SHARD_TOPOLOGY"


def transitions(log: DataFrame) -> DataFrame:
    """Each phase with its end: where the next one of the same migration and shard begins."""
    order = Window.partitionBy("migration", "shard").orderBy("at", "event_id")
    return log.withColumn("end_at", F.lead("at").over(order)).withColumn("next_phase", F.lead("phase").over(order))


def gate(reports: DataFrame, expected: DataFrame, target: str) -> DataFrame:
    """migration, outcome: FAILED if a shard failed, else REACHED if all expected ones are there, else WAITING."""
    joined = expected.join(reports, ["migration", "shard"], "left")
    flags = joined.groupBy("migration").agg(F.bool_or(F.coalesce(F.col("phase").isin("FAILED", "FAILING"), F.lit(False))).alias("failed"), F.bool_and(beyond(F.col("phase"), target)).alias("reached"))
    return flags.select("migration", F.when(F.col("failed"), "FAILED").when(F.col("reached"), "REACHED").otherwise("WAITING").alias("outcome"), "reached")


def stale(seen: DataFrame, now: int, timeout_ms: int, grace_until: int = 0) -> DataFrame:
    """Shards not seen since strictly before now - timeout; none in the grace period."""
    return seen.where((F.col("last_seen") < now - timeout_ms) & F.lit(now >= grace_until))


def admitted(waiting: DataFrame, permits: int) -> DataFrame:
    """The first `permits` of each node in order of arrival; 0 pauses all."""
    order = Window.partitionBy("node").orderBy("arrived", "worker")
    return waiting.withColumn("place", F.row_number().over(order).cast("long")).withColumn("granted", F.col("place") <= permits)


def our_leases(leases: DataFrame, prefix: str) -> DataFrame:
    """Leases with our prefix, once for each (index, shard, lease), whatever copies report them."""
    return leases.where(F.col("lease_id").startswith(prefix)).dropDuplicates(["index", "shard", "lease_id"])


def clear_plan(states: DataFrame, active: DataFrame, only: str | None = None, dry_run: bool = True) -> DataFrame:
    """migration_id and what is (or would be) cleared of each of both sets."""
    word = "would_clear" if dry_run else "cleared"
    a = states.select("migration_id", F.lit(True).alias("in_state"), "phase")
    b = active.select("migration_id", F.lit(True).alias("in_active"))
    plan = a.join(b, "migration_id", "full_outer")
    plan = plan.where(F.col("migration_id") == only) if only else plan
    said = lambda c: F.when(F.col(c), word).otherwise("not_found")
    return plan.select("migration_id", "phase", said("in_state").alias("cluster_state"), said("in_active").alias("active"))
