"""The engine's inputs over the test tables: change log, snapshot, documents, bulk outcomes, phase log, migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.routing import shard_of

CUTOFF = "2024-01-16"
SOURCE_SHARDS = 3
#: The phases of a migration and of a shard, in their order, and those that end.
COORDINATOR_PHASES = ("INITIALIZING", "ACTIVE", "PREPARING_TARGET", "CUTTING_OVER", "CATCHING_UP", "COMPLETING", "COMPLETED", "CANCELLING", "CANCELLED", "FAILING", "FAILED")
SHARD_PHASES = ("PENDING", "ACQUIRING_LEASE", "BACKFILLING", "REPLAYING", "CONVERGING", "CONVERGED", "CATCHING_UP", "COMPLETING", "COMPLETED", "CANCELLING", "FAILING", "CANCELLED", "FAILED")
TERMINAL = ("COMPLETED", "CANCELLED", "FAILED")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def op_log(spark: SparkSession, sf_dir: str, ident: Column | None = None, shards: int = SOURCE_SHARDS) -> DataFrame:
    """source_shard, seq_no, op, _id, _routing, event_type, value, props, ts. A real log carries its seq_no; here arrival order gives it."""
    events = table(spark, sf_dir, "events")
    user = F.col("user_id")
    rows = events.select(
        "event_id", "ts", "event_type", "value", "props",
        (F.concat(F.lit("u"), user, F.lit("-"), F.col("event_id") % 4) if ident is None else ident).alias("_id"),
        F.when(user % 3 != 0, F.concat(F.lit("tenant-"), user % 10)).alias("_routing"),
        F.when(F.col("event_type") == "signup", "CREATE").when(F.col("event_type") == "error", "DELETE").when(F.col("event_type") == "view", "NO_OP").otherwise("INDEX").alias("op"),
    )
    return numbered(rows.withColumn("source_shard", shard_of(F.coalesce("_routing", "_id"), shards)), "source_shard", "event_id", "seq_no")


#: Ids whose rows are numbered by one task.
RUN = 1 << 16


def numbered(df: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """df and `out`: the place of each row in its key's order, from 0. Runs of ids are numbered apart and moved by what lies before them, so no task sees a whole key."""
    rows = df.withColumn("__run", F.floor(F.col(order) / RUN))
    sizes = df.select(key, F.floor(F.col(order) / RUN).alias("__run")).groupBy(key, "__run").agg(F.count("*").alias("__n"))
    # One row for each run.
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(key).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy(key, "__run").orderBy(order)) - 1
    return rows.withColumn("__place", place).join(before, [key, "__run"]).withColumn(out, (F.col("__place") + F.col("__before")).cast("long")).drop("__run", "__place", "__before")


def cutoffs(log: DataFrame) -> DataFrame:
    """source_shard, cutoff: the last seq_no before the snapshot, -1 if none."""
    before = F.when(F.col("ts") < F.lit(CUTOFF).cast("timestamp_ntz"), F.col("seq_no"))
    return log.groupBy("source_shard").agg(F.coalesce(F.max(before), F.lit(-1)).cast("long").alias("cutoff"))


def orders_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat documents: _id, _routing, status, price, priority, custkey."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("_id"), F.concat(F.lit("tenant-"), F.col("o_custkey") % 10).alias("_routing"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("custkey"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk outcomes of each writer (user) in order of tick: took, items, bytes, success."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("writer"), F.col("event_id").alias("tick"), F.col("value").alias("took"), (F.col("event_id") % 50 + 1).alias("items"),
        F.floor(F.col("value") * 1000).cast("long").alias("bytes"), (F.col("event_type") != "error").alias("success"),
    )


def phase_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """migration, shard, phase, at (ms): events as phase changes."""
    e = table(spark, sf_dir, "events")
    phase = {"signup": "PENDING", "purchase": "BACKFILLING", "view": "REPLAYING", "click": "CONVERGED", "error": "FAILING"}
    named = F.create_map(*[F.lit(x) for kv in phase.items() for x in kv])
    return e.select(
        F.col("user_id").alias("migration"), (F.col("event_id") % 3).alias("shard"), F.element_at(named, F.col("event_type")).alias("phase"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "event_id",
    )


def migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored migration records: id, source, phase, start, updated."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    start = F.lit(1704067200000) + (key * 37 % 1000) * 1000
    return s.select(
        F.concat(F.lit("m"), key).alias("migration_id"), F.concat(F.lit("idx-"), F.col("s_nationkey")).alias("source_index"), F.concat(F.lit("idx-"), F.col("s_nationkey"), F.lit("-v2")).alias("target_index"),
        pick(COORDINATOR_PHASES, key).alias("phase"), start.alias("start_ms"), (start + F.floor(F.col("s_acctbal")).cast("long") * 10).alias("updated_ms"), key.alias("n"),
    )


def shard_states(migrations: DataFrame) -> DataFrame:
    """Three shards a migration: migration_id, shard, phase (null for some), docs (null for some)."""
    rows = migrations.select("migration_id", "n", F.explode(F.array(*(F.lit(k).cast("long") for k in range(3)))).alias("shard"))
    code = F.col("n") + F.col("shard")
    return rows.select("migration_id", "shard", F.when(code % 17 != 0, pick(SHARD_PHASES, code)).alias("phase"), F.when(code % 5 != 0, code * 11).alias("docs"))
