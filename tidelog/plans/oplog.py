"""Change-log scans, replay accounts and the merge."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import reconcile as R
from ..sources.fixtures import cutoffs, op_log
from . import sql as S
from .registry import query

LOG = "with " + S.op_log()


@query("oplog_range", f"{LOG} select source_shard, seq_no, op, _id from op_log where seq_no between 10 and 200")
def oplog_range(spark, sf):
    return R.seq_range(op_log(spark, sf), 10, 200).select("source_shard", "seq_no", "op", "_id")


@query("oplog_gap_check", f"{LOG} select source_shard, min(seq_no) as first_seq, max(seq_no) as last_seq, count(*) as ops, max(seq_no) - min(seq_no) + 1 - count(*) as missing from op_log where op <> 'NO_OP' group by 1")
def oplog_gap_check(spark, sf):
    # No-ops are left out, so that there is something to find.
    ops = op_log(spark, sf).where("op <> 'NO_OP'").groupBy("source_shard").agg(F.min("seq_no").alias("first_seq"), F.max("seq_no").alias("last_seq"), F.count("*").alias("ops"))
    return ops.withColumn("missing", F.col("last_seq") - F.col("first_seq") + 1 - F.col("ops"))


@query("global_checkpoint", f"{LOG} select source_shard, max(seq_no) as checkpoint from op_log group by 1")
def global_checkpoint(spark, sf):
    return op_log(spark, sf).groupBy("source_shard").agg(F.max("seq_no").alias("checkpoint"))


@query("oplog_classify", f"{LOG} select source_shard, op, case when op in ('INDEX', 'CREATE') then 'index' when op = 'DELETE' then 'delete' else 'skipped' end as write_kind, count(*) as ops from op_log group by all")
def oplog_classify(spark, sf):
    return R.classified(op_log(spark, sf)).groupBy("source_shard", "op", "write_kind").agg(F.count("*").alias("ops"))


LATEST = """select target_shard, _id, {what} from (select *, row_number() over (partition by target_shard, _id order by seq_no desc, source_shard desc) as rn from routed) where rn = 1"""


@query("latest_op_per_key", f"{LOG}, routed as (select *, {S.shard('coalesce(_routing, _id)', 6)} as target_shard from op_log where op <> 'NO_OP') " + LATEST.format(what="op, seq_no"))
def latest_op_per_key(spark, sf):
    routed = op_log(spark, sf).where("op <> 'NO_OP'").withColumn("target_shard", R.shard_of(F.coalesce("_routing", "_id"), 6))
    last = routed.groupBy("target_shard", "_id").agg(F.max_by(F.struct("op", "seq_no"), F.struct("seq_no", "source_shard")).alias("l"))
    return last.select("target_shard", "_id", "l.op", "l.seq_no")


def merge_sql(ident: str = "_id", routing: str = "_routing", delete_ident: str | None = None, delete_routing: str | None = None) -> str:
    """Full outer join of snapshot and replayed log, unlike the plan's single fold."""
    d, dr = delete_ident or ident, delete_routing or routing
    route = S.shard("coalesce(r, i)", 6)
    return f"""{LOG},
live as (select * from (select o.*, row_number() over (partition by o.source_shard, _id order by seq_no desc) as rn from op_log o join cutoffs using (source_shard)
  where seq_no <= cutoff and op <> 'NO_OP') where rn = 1 and op <> 'DELETE'),
snap as (select *, {route} as target_shard from (select {ident} as i, {routing} as r, event_type, value, props, source_shard from live)),
kept as (select * from (select *, row_number() over (partition by target_shard, i order by source_shard desc) as rn from snap) where rn = 1),
ops as (select *, {route} as target_shard from (select case when op = 'DELETE' then {d} else {ident} end as i, case when op = 'DELETE' then {dr} else {routing} end as r,
  op, seq_no, event_type, value, props, o.source_shard from op_log o join cutoffs using (source_shard) where seq_no > cutoff and op <> 'NO_OP')),
last as (select * from (select *, row_number() over (partition by target_shard, i order by seq_no desc, source_shard desc) as rn from ops) where rn = 1)
select coalesce(l.target_shard, k.target_shard) as target_shard, coalesce(l.i, k.i) as _id, case when l.op is null then k.r else l.r end as _routing,
  coalesce(l.seq_no, -1) as seq_no, case when l.op is null then k.event_type else l.event_type end as event_type,
  case when l.op is null then k.value else l.value end as value, case when l.op is null then k.props else l.props end as props
from kept k full outer join last l on k.target_shard = l.target_shard and k.i = l.i where coalesce(l.op, 'INDEX') <> 'DELETE'"""


@query("merge_final_state", merge_sql())
def merge_final_state(spark, sf):
    log = op_log(spark, sf)
    return R.merged(log, cutoffs(log), 6)


def rekeyed(deletes: bool):
    """ctx id and routing become 't-' and the old id; deletes follow only if asked to."""

    def transform(ops):
        applies = F.lit(True) if deletes else F.col("op") != "DELETE"
        new = F.concat(F.lit("t-"), F.col("_id"))
        return ops.withColumn("_routing", F.when(applies, new).otherwise(F.col("_routing"))).withColumn("_id", F.when(applies, new).otherwise(F.col("_id")))

    return transform


@query("transform_rekey", merge_sql("'t-' || _id", "'t-' || _id", "_id", "_routing"))
def transform_rekey(spark, sf):
    log = op_log(spark, sf)
    return R.merged(log, cutoffs(log), 6, rekeyed(False))


@query("transform_delete_aware", merge_sql("'t-' || _id", "'t-' || _id"))
def transform_delete_aware(spark, sf):
    log = op_log(spark, sf)
    return R.merged(log, cutoffs(log), 6, rekeyed(True))


@query("transform_source_shard", f"{LOG} select source_shard, seq_no, _id, source_shard * 10 + 1 as tagged from op_log where op in ('INDEX', 'CREATE')")
def transform_source_shard(spark, sf):
    return R.classified(op_log(spark, sf)).where("write_kind = 'index'").select("source_shard", "seq_no", "_id", (F.col("source_shard") * 10 + 1).alias("tagged"))


@query("replay_idempotent", f"{LOG}, routed as (select *, {S.shard('coalesce(_routing, _id)', 6)} as target_shard from op_log where op <> 'NO_OP') select * from (" + LATEST.format(what="op, seq_no, value") + ") where op <> 'DELETE'")
def replay_idempotent(spark, sf):
    log = op_log(spark, sf).select(*R.COLUMNS)
    state = R.final_state(log.unionByName(log).withColumn("kind", F.col("op")), 6, ("kind", "value"))
    return state.select("target_shard", "_id", F.col("kind").alias("op"), "seq_no", "value")


@query("replay_counters", f"{LOG} select source_shard, count(*) filter (op <> 'NO_OP') as applied, count(*) filter (op = 'NO_OP') as skipped, max(seq_no) as last_seq_no from op_log join cutoffs using (source_shard) where seq_no > cutoff group by 1")
def replay_counters(spark, sf):
    log = op_log(spark, sf)
    return R.counters(R.after_cutoff(log, cutoffs(log)))


@query("replay_round", f"{LOG} select source_shard, min(cutoff) + 1 as first_seq, max(seq_no) as target_seq, count(*) as ops from op_log join cutoffs using (source_shard) where seq_no > cutoff and ts < timestamp '2024-01-20' group by 1")
def replay_round(spark, sf):
    log = op_log(spark, sf)
    bounded = log.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")).join(F.broadcast(cutoffs(log)), "source_shard").where("seq_no > cutoff")
    return bounded.groupBy("source_shard").agg((F.min("cutoff") + 1).alias("first_seq"), F.max("seq_no").alias("target_seq"), F.count("*").alias("ops"))


@query("replay_progress_running", f"""{LOG}, batches as (select source_shard, seq_no // 50 as batch, max(seq_no) filter (op <> 'NO_OP') as done from op_log group by all)
select source_shard, batch, coalesce(max(done) over (partition by source_shard order by batch), -1) as progress from batches""")
def replay_progress_running(spark, sf):
    batches = op_log(spark, sf).groupBy("source_shard", F.floor(F.col("seq_no") / 50).alias("batch")).agg(F.max(F.when(F.col("op") != "NO_OP", F.col("seq_no"))).alias("done"))
    running = Window.partitionBy("source_shard").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return batches.select("source_shard", "batch", F.coalesce(F.max("done").over(running), F.lit(-1)).cast("long").alias("progress"))


@query("replay_fanout_accounting", f"""{LOG}, t as (select unnest([0, 1, 2, 3])::bigint as j)
select source_shard, seq_no, source_shard * 4 + j as target_shard, case when j = 0 then 1 else 0 end::bigint as applied, case when j = 3 then seq_no else -1 end as progress_seq
from op_log, t where op = 'DELETE'""")
def replay_fanout_accounting(spark, sf):
    deletes = op_log(spark, sf).where("op = 'DELETE'").select("source_shard", "seq_no")
    return R.accounted(R.split_targets(deletes, 4), 4)


ROUNDS, DAYS, THRESHOLD = 5, 3, 500


@query("convergence_rounds", f"""{LOG}, rounds as (select unnest(range(0, {ROUNDS}))::bigint as round),
marks as (select source_shard, round, coalesce(max(seq_no) filter (ts < timestamp '2024-01-16' + to_days(({DAYS} * round)::int)), -1) as first_end,
  coalesce(max(seq_no) filter (ts < timestamp '2024-01-16' + to_days(({DAYS} * (round + 1))::int)), -1) as target,
  coalesce(max(seq_no) filter (ts < timestamp '2024-01-16' + to_days(({DAYS} * (round + 2))::int)), -1) as checkpoint from op_log, rounds group by all)
select source_shard, round, first_end + 1 as first_seq, target, greatest(0, checkpoint - target) as gap, greatest(0, checkpoint - target) <= {THRESHOLD} as converged from marks""")
def convergence_rounds(spark, sf):
    log = op_log(spark, sf)
    mark = lambda k: F.coalesce(F.max(F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz") + F.expr(f"interval {DAYS * k} days"), F.col("seq_no"))), F.lit(-1)).cast("long")
    marks = log.groupBy("source_shard").agg(F.array(*map(mark, range(ROUNDS + 2))).alias("m"))
    rounds = marks.select("source_shard", "m", F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1))).alias("r"))
    at = lambda k: F.get("m", F.col("r") + k)
    gap = F.greatest(F.lit(0), at(2) - at(1))
    return rounds.select("source_shard", F.col("r").cast("long").alias("round"), (at(0) + 1).alias("first_seq"), at(1).alias("target"), gap.alias("gap"), (gap <= THRESHOLD).alias("converged"))
