"""Status, listing, phase log, gates, leases and clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.units import byte_sizes
from ..operators import state as X
from ..requests import REQUEST_SCHEMA
from ..sources.fixtures import TERMINAL, migrations, phase_log, shard_states, table
from ..validate import invalidated, local_primaries
from . import sql as S
from .registry import query

M, P = f"with {S.MIGRATIONS}", f"with {S.PHASES}"
TERMINALS = "('COMPLETED', 'CANCELLED', 'FAILED')"
ACTIVES = "(" + ", ".join(f"'{p}'" for p in X.ACTIVE) + ")"
LIST = "select migration_id, source_index, phase, start_ms, (select count(*) from migrations where {0}) > {1} as truncated, (select count(*) from migrations where phase not in " + TERMINALS + ") as active_count from migrations where {0} order by start_ms desc, migration_id limit {1}"
PAGE = ("migration_id", "source_index", "phase", "start_ms", "truncated", "active_count")


@query("list_migrations", M + " " + LIST.format("true", 20))
def list_migrations(spark, sf):
    return X.listed(migrations(spark, sf), "all", 20).select(*PAGE)


@query("list_migrations_active", M + " " + LIST.format(f"phase in {ACTIVES}", 50))
def list_migrations_active(spark, sf):
    return X.listed(migrations(spark, sf), " active ", None).select(*PAGE)


LIVE = "live as (select 'idx-' || n_nationkey as source_index, 'live-' || n_nationkey as migration_id, 'ACTIVE' as phase from nation where n_nationkey % 3 = 0 union all select 'idx-new', 'live-new', 'INITIALIZING')"


@query("list_overlay", f"""{M}, {LIVE}, o as (select m.source_index, case when l.migration_id is not null and m.phase not in {TERMINALS} then l.migration_id else m.migration_id end as migration_id,
  case when l.migration_id is not null and m.phase not in {TERMINALS} then l.phase else m.phase end as phase from migrations m left join live l using (source_index))
select * from o union all select source_index, migration_id, phase from live where source_index not in (select m.source_index from migrations m join live l using (source_index) where m.phase not in {TERMINALS})""")
def list_overlay(spark, sf):
    live = table(spark, sf, "nation").where("n_nationkey % 3 = 0").select(F.concat(F.lit("idx-"), "n_nationkey").alias("source_index"), F.concat(F.lit("live-"), "n_nationkey").alias("migration_id"), F.lit("ACTIVE").alias("phase"))
    live = live.union(spark.createDataFrame([("idx-new", "live-new", "INITIALIZING")], live.schema))
    return X.overlaid(migrations(spark, sf).select("source_index", "migration_id", "phase"), live)


@query("status_latest", f"{M} select source_index, arg_max(migration_id, (start_ms, n)) as migration_id, arg_max(phase, (start_ms, n)) as phase from migrations group by 1")
def status_latest(spark, sf):
    last = migrations(spark, sf).groupBy("source_index").agg(F.max_by(F.struct("migration_id", "phase"), F.struct("start_ms", "n")).alias("m"))
    return last.select("source_index", "m.migration_id", "m.phase")


@query("summary_projection", f"""{M}, c as (select migration_id, count(*) as shard_count from shards where phase is not null group by 1)
select migration_id, source_index, phase, phase in {TERMINALS} as is_terminal, coalesce(shard_count, 0) as shard_count, case when updated_ms < start_ms then 0 else (updated_ms - start_ms) // 1000 end as elapsed_seconds from migrations left join c using (migration_id)""")
def summary_projection(spark, sf):
    m = migrations(spark, sf)
    return X.summaries(m, shard_states(m))


@query("shards_by_phase", f"{M}, c as (select migration_id, phase, count(*) as n from shards where phase is not null group by 1, 2) select migration_id, string_agg(phase || '=' || n, ',' order by phase) as phases from c group by 1")
def shards_by_phase(spark, sf):
    counts = shard_states(migrations(spark, sf)).where("phase is not null").groupBy("migration_id", "phase").agg(F.count("*").alias("n"))
    sorted_map = F.map_from_entries(F.array_sort(F.collect_list(F.struct("phase", "n"))))
    maps = counts.groupBy("migration_id").agg(sorted_map.alias("m"))
    return maps.select("migration_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("phases"))


@query("shard_progress_explode", f"{M} select migration_id, shard, phase from shards where migration_id = 'm7'")
def shard_progress_explode(spark, sf):
    states = shard_states(migrations(spark, sf))
    record = states.groupBy("migration_id").agg(F.map_from_entries(F.collect_list(F.struct("shard", F.struct("phase", "docs")))).alias("shards"))
    return record.where("migration_id = 'm7'").select("migration_id", F.explode("shards").alias("shard", "s")).select("migration_id", "shard", "s.phase")


@query("progress_totals", f"{M} select migration_id, sum(coalesce(docs, 0))::bigint as documents from shards group by 1")
def progress_totals(spark, sf):
    return shard_states(migrations(spark, sf)).groupBy("migration_id").agg(F.sum(F.coalesce("docs", F.lit(0))).alias("documents"))


@query("create_if_absent", f"{M} select source_index, count(*) as stored, false as created from migrations group by 1 union all select 'idx-' || (n_nationkey + 20), 0, true from nation where 'idx-' || (n_nationkey + 20) not in (select source_index from migrations)")
def create_if_absent(spark, sf):
    stored = migrations(spark, sf).groupBy("source_index").agg(F.count("*").alias("stored")).withColumn("created", F.lit(False))
    asked = table(spark, sf, "nation").select(F.concat(F.lit("idx-"), F.col("n_nationkey") + 20).alias("source_index"))
    new = asked.join(stored, "source_index", "left_anti").select("source_index", F.lit(0).cast("long").alias("stored"), F.lit(True).alias("created"))
    return stored.union(new)


@query("cutover_summary", f"{M} select migration_id, greatest(0, updated_ms - start_ms) as duration_ms, phase = 'COMPLETED' as swapped from migrations")
def cutover_summary(spark, sf):
    return migrations(spark, sf).select("migration_id", F.greatest(F.lit(0), F.col("updated_ms") - F.col("start_ms")).alias("duration_ms"), (F.col("phase") == "COMPLETED").alias("swapped"))


@query("clear_state_plan", f"""{M}, a as (select migration_id, phase from migrations where n % 2 = 0), b as (select migration_id from migrations where n % 3 = 0)
select migration_id, a.phase, case when a.phase is not null then 'would_clear' else 'not_found' end as cluster_state, case when b.migration_id is not null then 'would_clear' else 'not_found' end as active from a full outer join b using (migration_id)""")
def clear_state_plan(spark, sf):
    m = migrations(spark, sf)
    return X.clear_plan(m.where("n % 2 = 0"), m.where("n % 3 = 0"))


LEASES = """leases as (select source_index as "index", n % 3 as shard, case when n % 4 = 0 then 'peer-' else 'tide-migration-' end || migration_id as lease_id, unnest(['primary', 'replica']) as copy from migrations)"""


def leases(spark, sf):
    m = migrations(spark, sf)
    lease = F.concat(F.when(F.col("n") % 4 == 0, "peer-").otherwise("tide-migration-"), "migration_id")
    return m.select(F.col("source_index").alias("index"), (F.col("n") % 3).alias("shard"), lease.alias("lease_id"), "phase", F.explode(F.array(F.lit("primary"), F.lit("replica"))).alias("copy"))


@query("lease_discovery", f"""{M}, {LEASES} select distinct "index", shard, lease_id from leases where lease_id like 'tide-migration-%'""")
def lease_discovery(spark, sf):
    return X.our_leases(leases(spark, sf), "tide-migration-").select("index", "shard", "lease_id")


@query("lease_cleanup_plan", f"""{M}, {LEASES}, d as (select distinct "index", shard, lease_id from leases where lease_id like 'tide-migration-%')
select "index", count(*) filter (shard <> 2) as released, count(*) filter (shard = 2) as failed from d group by 1""")
def lease_cleanup_plan(spark, sf):
    ours = X.our_leases(leases(spark, sf), "tide-migration-")
    return ours.groupBy("index").agg(F.count_if(F.col("shard") != 2).alias("released"), F.count_if(F.col("shard") == 2).alias("failed"))


@query("orphan_workers", f"{M} select migration_id || '-' || shard as worker, migration_id from shards where migration_id not in (select migration_id from migrations where phase not in {TERMINALS})")
def orphan_workers(spark, sf):
    m = migrations(spark, sf)
    workers = shard_states(m).select(F.concat_ws("-", "migration_id", "shard").alias("worker"), "migration_id")
    return workers.join(m.where(~F.col("phase").isin(*TERMINAL)), "migration_id", "left_anti").select("worker", "migration_id")


@query("plugin_consistency", "select s_nationkey % 3 as cluster, count(distinct s_nationkey % 7) as versions, count(*) filter (s_nationkey % 7 = 6) as missing, count(distinct s_nationkey % 7) > 1 as rejected from supplier group by 1")
def plugin_consistency(spark, sf):
    nodes = table(spark, sf, "supplier").select((F.col("s_nationkey") % 3).alias("cluster"), (F.col("s_nationkey") % 7).alias("version"))
    return nodes.groupBy("cluster").agg(F.countDistinct("version").alias("versions"), F.count_if(F.col("version") == 6).alias("missing")).withColumn("rejected", F.col("versions") > 1)


# --- where the shards are ---

PRIMARIES = """primaries as (select 'idx-' || n_nationkey as source_index, shard, case when n_nationkey % 5 = 1 and shard = 1 then null when n_nationkey % 4 = 0 and shard = 2 then 'RELOCATING' else 'STARTED' end as state
  from nation, (select unnest([0, 1, 2])::bigint as shard) where n_nationkey % 7 <> 3)"""


def primaries(spark, sf):
    n, shard = F.col("n_nationkey"), F.col("shard")
    rows = table(spark, sf, "nation").where(n % 7 != 3).withColumn("shard", F.explode(F.array(*(F.lit(k).cast("long") for k in range(3)))))
    state = F.when((n % 5 == 1) & (shard == 1), None).when((n % 4 == 0) & (shard == 2), "RELOCATING").otherwise("STARTED")
    return rows.select(F.concat(F.lit("idx-"), "n_nationkey").alias("source_index"), "shard", state.alias("state"))


@query("topology_invalid", f"""{M}, {PRIMARIES}, u as (select m.migration_id, p.shard, case when p.shard is null then 'source is gone' when p.state is null then 'no primary of shard ' || p.shard when p.state <> 'STARTED' then 'shard ' || p.shard || ' is ' || p.state end as reason
  from migrations m left join primaries p using (source_index) left join shards s on s.migration_id = m.migration_id and s.shard = p.shard
  where m.phase not in ('COMPLETED', 'CANCELLED', 'FAILED', 'FAILING', 'CANCELLING', 'COMPLETING') and s.phase is distinct from 'COMPLETED')
select migration_id, arg_min(reason, coalesce(shard, -1)) as reason from u where reason is not null group by 1""")
def topology_invalid(spark, sf):
    m = migrations(spark, sf)
    return invalidated(m, primaries(spark, sf), shard_states(m))


@query("local_primaries", f"""{M} select 'idx-' || s_nationkey as source_index, s_suppkey % 3 as shard from supplier where s_suppkey % 4 = 2 and s_suppkey % 2 = 0
and 'idx-' || s_nationkey in (select source_index from migrations where phase not in {TERMINALS})""")
def local_primaries_of_node(spark, sf):
    k = F.col("s_suppkey")
    shards = table(spark, sf, "supplier").select(F.concat(F.lit("idx-"), "s_nationkey").alias("source_index"), (k % 3).alias("shard"), F.concat(F.lit("node-"), k % 4).alias("node"), (k % 2 == 0).alias("is_primary"))
    return local_primaries(shards, migrations(spark, sf).where(~F.col("phase").isin(*TERMINAL)), "node-2")


# --- requests and units ---

BODY = """'{"source_index": "s' || c_custkey || '", "target_index": ' || case when c_custkey % 5 = 0 then 'null' else '"t' || c_custkey || '"' end || ', "junk": 1, "alias": "a", "transform_script": {"type": "' || case when c_custkey % 2 = 0 then 'inline' else 'stored' end || '"}, "options": {"tolerance": ' || c_custkey % 9 || '}}'"""


@query("requests_decode", f"""with t as (select c_custkey, {BODY} as body from customer)
select c_custkey, json_extract_string(body, '$.source_index') as source_index, json_extract_string(body, '$.target_index') as target_index, json_extract_string(body, '$.transform_script.type') as script,
  json_extract(body, '$.options.tolerance')::bigint as tolerance, json_extract_string(body, '$.target_index') is null as rejected from t""")
def requests_decode(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.from_json(F.expr(BODY), REQUEST_SCHEMA).alias("r"))
    wrong = F.col("r.source_index").isNull() | F.col("r.target_index").isNull() | F.col("r.alias").isNull() | F.coalesce(F.col("r.source_index") == F.col("r.target_index"), F.lit(False))
    return rows.select("c_custkey", "r.source_index", "r.target_index", F.col("r.transform_script.type").alias("script"), "r.options.tolerance", wrong.alias("rejected"))


UNIT = "['b', 'kb', 'mb', 'gb', 'KB', 'parsec', ''][c_custkey % 7 + 1]"


@query("byte_sizes_parse", f"""select c_custkey, c_custkey || {UNIT} as said, case c_custkey % 7 when 0 then 1 when 1 then 1024 when 2 then 1048576 when 3 then 1073741824 when 4 then 1024 end * c_custkey as bytes from customer""")
def byte_sizes_parse(spark, sf):
    said = F.concat("c_custkey", F.element_at(F.array(*map(F.lit, ("b", "kb", "mb", "gb", "KB", "parsec", ""))), (F.col("c_custkey") % 7 + 1).cast("int")))
    rows = table(spark, sf, "customer").select("c_custkey", said.alias("said"))
    return rows.withColumn("bytes", byte_sizes(F.col("said")))


# --- the phase log ---

NEXT = f"{P}, t as (select *, lead(at_ms) over w as end_ms, lead(phase) over w as next_phase from phases window w as (partition by migration, shard order by at_ms, event_id))"


@query("transition_history", f"{NEXT} select migration, shard, phase, at_ms as start_ms, end_ms, end_ms - at_ms as duration_ms from t")
def transition_history(spark, sf):
    t = X.transitions(phase_log(spark, sf))
    return t.select("migration", "shard", "phase", F.col("at").alias("start_ms"), F.col("end_at").alias("end_ms"), (F.col("end_at") - F.col("at")).alias("duration_ms"))


@query("illegal_transitions", f"""{NEXT} select phase, next_phase, count(*) as n from t where next_phase is not null and not (next_phase = 'FAILING'
  or (phase || '>' || next_phase) in ('PENDING>ACQUIRING_LEASE', 'BACKFILLING>REPLAYING', 'REPLAYING>CONVERGING', 'CONVERGED>CATCHING_UP')) group by all""")
def illegal_transitions(spark, sf):
    t = X.transitions(phase_log(spark, sf)).where("next_phase is not null")
    return t.where(~X.allowed(F.col("phase"), F.col("next_phase"))).groupBy("phase", "next_phase").agg(F.count("*").alias("n"))


NOW, TIMEOUT = 1706572800000, 86_400_000


@query("stale_shards", f"{P}, s as (select migration, shard, max(at_ms) as last_seen from phases group by all) select * from s where last_seen < {NOW - TIMEOUT}")
def stale_shards(spark, sf):
    return X.stale(phase_log(spark, sf).groupBy("migration", "shard").agg(F.max("at").alias("last_seen")), NOW, TIMEOUT)


@query("coalesce_latest", f'{P} select at_ms // 86400000 as "window", shard, arg_max(phase, event_id) as phase, count(*) - 1 as superseded from phases group by all')
def coalesce_latest(spark, sf):
    return phase_log(spark, sf).groupBy(F.floor(F.col("at") / 86_400_000).alias("window"), "shard").agg(F.max_by("phase", "event_id").alias("phase"), (F.count("*") - 1).alias("superseded"))


@query("permit_admission", f"{P}, w as (select shard as node, migration as worker, min(at_ms) as arrived from phases group by all) select *, row_number() over (partition by node order by arrived, worker) as place, row_number() over (partition by node order by arrived, worker) <= 2 as granted from w")
def permit_admission(spark, sf):
    waiting = phase_log(spark, sf).groupBy(F.col("shard").alias("node"), F.col("migration").alias("worker")).agg(F.min("at").alias("arrived"))
    return X.admitted(waiting, 2)


GATE = f"""{P}, r as (select migration, shard, arg_max(phase, event_id) as phase from phases group by all), e as (select distinct migration, unnest([0, 1, 2])::bigint as shard from phases),
g as (select migration, bool_or(coalesce(phase in ('FAILED', 'FAILING'), false)) as failed, bool_and(coalesce(phase in ('REPLAYING', 'CONVERGED'), false)) as reached from e left join r using (migration, shard) group by 1)"""


def gates(spark, sf):
    reports = phase_log(spark, sf).groupBy("migration", "shard").agg(F.max_by("phase", "event_id").alias("phase"))
    expected = reports.select("migration").distinct().select("migration", F.explode(F.array(*(F.lit(k).cast("long") for k in range(3)))).alias("shard"))
    return X.gate(reports, expected, "REPLAYING")


@query("gate_all_reached", f"{GATE} select migration, reached from g")
def gate_all_reached(spark, sf):
    return gates(spark, sf).select("migration", "reached")


@query("gate_outcome", f"{GATE} select migration, case when failed then 'FAILED' when reached then 'REACHED' else 'WAITING' end as outcome from g")
def gate_outcome(spark, sf):
    return gates(spark, sf).select("migration", "outcome")
