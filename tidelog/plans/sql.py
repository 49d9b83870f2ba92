"""DuckDB spellings of the inputs, for the oracles."""

from __future__ import annotations

from ..sources.fixtures import COORDINATOR_PHASES, CUTOFF, SHARD_PHASES


def h(v: str) -> str:
    return f"(('0x' || substr(md5({v}), 1, 8))::bigint)"


def shard(v: str, n: int) -> str:
    return f"(({h(v)} % 720) // {720 // n})"


def listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def op_log(ident: str = "'u' || user_id || '-' || (event_id % 4)", shards: int = 3) -> str:
    return f"""named as (select event_id, ts, event_type, value, props, {ident} as _id,
  case when user_id % 3 <> 0 then 'tenant-' || (user_id % 10) end as _routing,
  case event_type when 'signup' then 'CREATE' when 'error' then 'DELETE' when 'view' then 'NO_OP' else 'INDEX' end as op from events),
op_log as (select *, (row_number() over (partition by source_shard order by event_id) - 1)::bigint as seq_no
  from (select *, {shard("coalesce(_routing, _id)", shards)} as source_shard from named)),
cutoffs as (select source_shard, coalesce(max(seq_no) filter (ts < timestamp '{CUTOFF}'), -1) as cutoff from op_log group by 1)"""


ORDERS = """docs as (select o_orderkey::varchar as _id, 'tenant-' || (o_custkey % 10) as _routing, o_orderstatus as status,
  o_totalprice as price, o_orderpriority as priority, o_custkey as custkey from orders)"""
OUTCOMES = """outcomes as (select user_id as writer, event_id as tick, value as took, event_id % 50 + 1 as items,
  floor(value * 1000)::bigint as bytes, event_type <> 'error' as success, row_number() over (partition by user_id order by event_id) as k from events)"""
PHASES = """phases as (select user_id as migration, event_id % 3 as shard, case event_type when 'signup' then 'PENDING' when 'purchase' then 'BACKFILLING'
  when 'view' then 'REPLAYING' when 'click' then 'CONVERGED' else 'FAILING' end as phase, epoch_us(ts) // 1000 as at_ms, event_id from events)"""
MIGRATIONS = f"""migrations as (select 'm' || s_suppkey as migration_id, 'idx-' || s_nationkey as source_index, 'idx-' || s_nationkey || '-v2' as target_index,
  ({listed(COORDINATOR_PHASES)})[s_suppkey % 11 + 1] as phase, 1704067200000 + (s_suppkey * 37 % 1000) * 1000 as start_ms,
  1704067200000 + (s_suppkey * 37 % 1000) * 1000 + floor(s_acctbal)::bigint * 10 as updated_ms, s_suppkey as n from supplier),
shards as (select migration_id, shard, case when (n + shard) % 17 <> 0 then ({listed(SHARD_PHASES)})[(n + shard) % 13 + 1] end as phase,
  case when (n + shard) % 5 <> 0 then (n + shard) * 11 end as docs from migrations, (select unnest([0, 1, 2])::bigint as shard))"""
