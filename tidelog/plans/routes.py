"""Routing of documents and deletes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.routing import mode_of, shard_of
from ..operators import reconcile as R
from ..sources.fixtures import op_log, table, orders_docs
from . import sql as S
from .registry import query

LOG = "with " + S.op_log()
TOPOLOGIES = ((2, 2), (2, 4), (3, 6), (4, 2), (6, 3), (1, 4), (4, 1), (3, 9), (3, 12), (5, 3), (2, 8), (8, 2))


@query("route_docs", f"with {S.ORDERS} select _id, coalesce(_routing, _id) as routed_by, {S.shard('coalesce(_routing, _id)', 12)} as shard from docs")
def route_docs(spark, sf):
    by = F.coalesce("_routing", "_id")
    return orders_docs(spark, sf).select("_id", by.alias("routed_by"), shard_of(by, 12).alias("shard"))


@query("routing_mode_matrix", f"""with t as (select unnest({[list(x) for x in TOPOLOGIES]}) as p)
select p[1]::bigint as source_shards, p[2]::bigint as target_shards, case when p[1] = p[2] then 'SAME'
  when p[2] > p[1] and p[2] % p[1] = 0 and bit_count(p[2] // p[1]) = 1 then 'SPLIT' when p[1] > p[2] and p[1] % p[2] = 0 and bit_count(p[1] // p[2]) = 1 then 'SHRINK' else 'BULK_API' end as mode from t""")
def routing_mode_matrix(spark, sf):
    return spark.createDataFrame(TOPOLOGIES, "source_shards long, target_shards long").withColumn("mode", mode_of(F.col("source_shards"), F.col("target_shards")))


def keys_sql(n: int) -> str:
    return f"keys as (select {S.shard('v', n)} as target_shard, arg_min(v, i) as routing from (select i, 'route-0-' || i as v from range({max(20 * n, 0)}) t(i)) group by 1)"


@query("synthetic_routing", f"with {keys_sql(12)} select * from keys")
def synthetic_routing(spark, sf):
    return R.synthetic_keys(spark, 12)


def deletes(spark, sf, shards=3):
    return op_log(spark, sf, shards=shards).where("op = 'DELETE'").select("source_shard", "seq_no", "_id", "_routing")


@query("delete_route_recorded", f"{LOG} select source_shard, seq_no, _id, _routing as routing, {S.shard('coalesce(_routing, _id)', 12)} as target_shard from op_log where op = 'DELETE'")
def delete_route_recorded(spark, sf):
    return deletes(spark, sf).select("source_shard", "seq_no", "_id", F.col("_routing").alias("routing"), shard_of(F.coalesce("_routing", "_id"), 12).alias("target_shard"))


def keyed(rows, keys):
    # The key table has one row a shard.
    return rows.join(F.broadcast(keys), "target_shard").select("source_shard", "seq_no", "_id", "routing", "target_shard")


@query("delete_route_same", f"{LOG}, {keys_sql(3)} select source_shard, seq_no, _id, routing, target_shard from op_log join keys on target_shard = source_shard where op = 'DELETE'")
def delete_route_same(spark, sf):
    return keyed(deletes(spark, sf).withColumn("target_shard", F.col("source_shard")), R.synthetic_keys(spark, 3))


@query("delete_route_split", f"{LOG}, {keys_sql(12)} select source_shard, seq_no, _id, routing, target_shard from op_log join keys on target_shard // 4 = source_shard where op = 'DELETE'")
def delete_route_split(spark, sf):
    return keyed(R.split_targets(deletes(spark, sf), 4), R.synthetic_keys(spark, 12))


@query("delete_route_fallback", f"""{LOG}, {keys_sql(12)}, d as (select source_shard, seq_no, _id, target_shard, routing from op_log, unnest(range(source_shard * 4, source_shard * 4 + 4)) t(target_shard) left join (select * from keys where target_shard % 5 <> 2) using (target_shard) where op = 'DELETE')
select source_shard, seq_no, _id, routing, target_shard from d where routing is not null union all select distinct source_shard, seq_no, _id, null, null from d where routing is null""")
def delete_route_fallback(spark, sf):
    keys = R.synthetic_keys(spark, 12).where("target_shard % 5 <> 2")
    return R.routed_or_not(R.split_targets(deletes(spark, sf), 4), keys).select("source_shard", "seq_no", "_id", "routing", "target_shard")


PARTITIONED = "n_nationkey % 6 = 0 and n_regionkey <> 2"


@query("partitioned_routing_guard", f"select 'idx-' || n_nationkey as idx, case when n_nationkey % 6 = 0 then 4 else 1 end as routing_partition_size, {PARTITIONED} as rejected from nation")
def partitioned_routing_guard(spark, sf):
    rows = table(spark, sf, "nation").select(F.concat(F.lit("idx-"), "n_nationkey").alias("idx"), F.when(F.col("n_nationkey") % 6 == 0, 4).otherwise(1).alias("routing_partition_size"), F.when(F.col("n_regionkey") == 2, "TRANSLOG_ROUTING").otherwise("SHARD_TOPOLOGY").alias("strategy"))
    return rows.select("idx", "routing_partition_size", ((F.col("routing_partition_size") > 1) & (F.col("strategy") == "SHARD_TOPOLOGY")).alias("rejected"))


@query("delete_route_shrink", f"with {S.op_log(shards=6)}, {keys_sql(3)} select source_shard, seq_no, _id, routing, target_shard from op_log join keys on target_shard = source_shard // 2 where op = 'DELETE'")
def delete_route_shrink(spark, sf):
    return keyed(deletes(spark, sf, 6).withColumn("target_shard", F.floor(F.col("source_shard") / 2)), R.synthetic_keys(spark, 3))


@query("delete_route_bulk", f"{LOG} select source_shard, seq_no, _id, null::varchar as routing, {S.shard('_id', 9)} as target_shard from op_log where op = 'DELETE'")
def delete_route_bulk(spark, sf):
    return deletes(spark, sf).select("source_shard", "seq_no", "_id", F.lit(None).cast("string").alias("routing"), shard_of(F.col("_id"), 9).alias("target_shard"))


@query("bulk_stale_deletes", f"{LOG}, d as (select source_shard, seq_no, _id, {S.shard('_id', 9)} as sent_to, {S.shard('coalesce(_routing, _id)', 9)} as lies_in from op_log where op = 'DELETE') select * from d where sent_to <> lies_in")
def bulk_stale_deletes(spark, sf):
    rows = deletes(spark, sf).select("source_shard", "seq_no", "_id", shard_of(F.col("_id"), 9).alias("sent_to"), shard_of(F.coalesce("_routing", "_id"), 9).alias("lies_in"))
    return rows.where("sent_to <> lies_in")


@query("copy_collisions", f"""with {S.op_log("'c' || (user_id % 7)", 6)}
select target_shard, _id, count(distinct source_shard) as source_shards from (select source_shard, _id, {S.shard('coalesce(_routing, _id)', 3)} as target_shard from op_log where op in ('INDEX', 'CREATE')) group by 1, 2 having count(distinct source_shard) > 1""")
def copy_collisions(spark, sf):
    log = op_log(spark, sf, F.concat(F.lit("c"), F.col("user_id") % 7), 6).where("op in ('INDEX', 'CREATE')")
    routed = log.select("source_shard", "_id", shard_of(F.coalesce("_routing", "_id"), 3).alias("target_shard"))
    return routed.groupBy("target_shard", "_id").agg(F.countDistinct("source_shard").alias("source_shards")).where("source_shards > 1")


@query("split_containment", f"with v as (select i::varchar as v from range(20000) t(i)) select {S.shard('v', 3)} as source_shard, count(*) as ids, count(*) filter ({S.shard('v', 12)} // 4 <> {S.shard('v', 3)}) as violations from v group by 1")
def split_containment(spark, sf):
    ids = spark.range(20000).select(F.col("id").cast("string").alias("v"))
    source, target = shard_of(F.col("v"), 3), shard_of(F.col("v"), 12)
    return ids.groupBy(source.alias("source_shard")).agg(F.count("*").alias("ids"), F.count_if(F.floor(target / 4) != source).alias("violations"))


VERSIONS = (("a", 3, 9), ("a", 3, 10), ("b", 3, 8), ("b", 3, 9), ("c", 4, 0))


@query("delete_strategy", f"""with t as (select unnest({[[c, str(a), str(b)] for c, a, b in VERSIONS]}) as p)
select p[1] as cluster, case when min(p[2]::int * 1000 + p[3]::int) >= 3009 then 'TRANSLOG_ROUTING' else 'SHARD_TOPOLOGY' end as strategy from t group by 1""")
def delete_strategy(spark, sf):
    nodes = spark.createDataFrame(VERSIONS, "cluster string, major int, minor int")
    return nodes.groupBy("cluster").agg(F.when(F.min(F.col("major") * 1000 + F.col("minor")) >= 3009, "TRANSLOG_ROUTING").otherwise("SHARD_TOPOLOGY").alias("strategy"))
