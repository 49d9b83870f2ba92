"""Backfill, transforms, validation and cutover over flat and nested documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scripts
from ..functions.routing import shard_of
from ..operators import cutover as C
from ..operators import transform as X
from ..requests import Script
from ..scripts import transform_of
from ..sources.fixtures import orders_docs, table
from . import sql as S
from .registry import query

DOCS = f"with {S.ORDERS}"
ALL = "_id, _routing, status, price, priority, custkey"


@query("backfill_snapshot", f"{DOCS} select {ALL} from docs")
def backfill_snapshot(spark, sf):
    return X.checked(orders_docs(spark, sf))


@query("backfill_root_docs", "with storage as (select o_orderkey::varchar as _id, null::varchar as parent from orders union all select l_orderkey || '-' || l_linenumber, l_orderkey::varchar from lineitem) select _id from storage where parent is null")
def backfill_root_docs(spark, sf):
    roots = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("_id"), F.lit(None).cast("string").alias("parent"))
    children = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("_id"), F.col("l_orderkey").cast("string").alias("parent"))
    return roots.unionByName(children).where("parent is null").select("_id")


SHARDED = f"{DOCS}, placed as (select _id, {S.shard('coalesce(_routing, _id)', 5)} as shard from docs)"


@query("backfill_pages", f"{SHARDED} select shard, count(*) as docs, ((count(*) + 999) // 1000)::bigint as pages from placed group by 1")
def backfill_pages(spark, sf):
    placed = orders_docs(spark, sf).groupBy(shard_of(F.coalesce("_routing", "_id"), 5).alias("shard")).agg(F.count("*").alias("docs"))
    return placed.withColumn("pages", F.ceil(F.col("docs") / 1000))


@query("backfill_counters", f"""{SHARDED}, numbered as (select shard, (row_number() over (partition by shard order by _id) - 1) // 500 as batch, _id from placed)
select shard, count(*) as docs, count(distinct batch) as batches, greatest(0, 2000 - count(*)) as gap from numbered group by 1""")
def backfill_counters(spark, sf):
    placed = orders_docs(spark, sf).select("_id", shard_of(F.coalesce("_routing", "_id"), 5).alias("shard"))
    counted = placed.groupBy("shard").agg(F.count("*").alias("docs"))
    # Batches of one shard are full but for the last, so their number follows from the count; no ordering needed.
    return counted.select("shard", "docs", F.ceil(F.col("docs") / 500).alias("batches"), F.greatest(F.lit(0), 2000 - F.col("docs")).cast("long").alias("gap"))


def transformed(key: str, sql: str, build, source=orders_docs):
    @query(key, sql)
    def run(spark, sf):
        return build(source(spark, sf))

    return run


transformed("transform_identity", f"{DOCS} select {ALL} from docs", X.named("identity"))
transformed("transform_add_field", f"{DOCS} select {ALL}, 2::bigint as version, true as migrated from docs", lambda d: X.set_field("migrated", True)(X.set_field("version", F.lit(2).cast("long"))(d)))
transformed("transform_param", f"{DOCS} select {ALL}, 'blue' as tag from docs", lambda d, params={"tag_value": "blue"}: X.set_field("tag", params["tag_value"])(d))
transformed("transform_remove_field", f"{DOCS} select _id, _routing, status, price, custkey from docs", X.remove_field("priority"))
transformed("transform_rename_field", f"{DOCS} select _id, _routing, status as state, price, priority, custkey from docs", X.rename_field("status", "state"))
transformed("transform_cast_long", f"{DOCS} select _routing, status, price, priority, custkey, _id::bigint as _id from docs", X.cast_long("_id"))
transformed("transform_drop", f"{DOCS} select {ALL} from docs where not (status = 'F')", lambda d: X.drop_where(F.col("status") == "F")(d))
transformed("transform_fanout", f"{DOCS} select unnest([_id || '-a', _id || '-b']) as _id, status, price from docs", lambda d: X.fan_out(F.array(F.concat("_id", F.lit("-a")), F.concat("_id", F.lit("-b"))), ["status", "price"])(d))


@query("transform_concat", "select c_custkey::varchar as _id, c_name || ' ' || c_mktsegment as full_name from customer")
def transform_concat(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("_id"), F.concat("c_name", F.lit(" "), "c_mktsegment").alias("full_name"))


@query("transform_default", "select c_custkey::varchar as _id, coalesce(case when c_custkey % 4 <> 0 then c_mktsegment end, 'UNKNOWN') as segment from customer")
def transform_default(spark, sf):
    docs = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("_id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("segment"))
    return X.default("segment", "UNKNOWN")(docs)


@query("transform_nested_upper", """select o.o_orderkey::varchar as _id, l.l_linenumber::bigint as line, upper(l.l_linestatus || '-' || l.l_returnflag || 'x') as name
from orders o join lineitem l on l.l_orderkey = o.o_orderkey""")
def transform_nested_upper(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("line"), F.concat("l_linestatus", F.lit("-"), "l_returnflag", F.lit("x")).alias("name"))).alias("tags"))
    docs = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").cast("string").alias("_id"), "tags")
    upper = docs.withColumn("tags", F.transform("tags", lambda t: t.withField("name", F.upper(t["name"]))))
    return upper.select("_id", F.explode("tags").alias("t")).select("_id", "t.line", "t.name")


COUNTS = f"{DOCS}, target as (select * from docs where custkey % 97 <> 0)"


@query("validation_counts", f"""{COUNTS} select 'match_all' as query, (select count(*) from docs) as source, (select count(*) from target) as target
union all select 'term', (select count(*) from docs where status = 'F'), (select count(*) from target where status = 'F')""")
def validation_counts(spark, sf):
    docs = orders_docs(spark, sf)
    return C.counts(docs, docs.where("custkey % 97 <> 0"), {"match_all": {"match_all": {}}, "term": {"term": {"status": "F"}}})


@query("cutover_validation", f"""{COUNTS}, c as (select (select count(*) from docs) as source, (select count(*) from target) as target), t as (select unnest([0, 100, 200, 100000])::bigint as tolerance)
select tolerance, source, target, abs(source - target) as difference, abs(source - target) <= tolerance as passed from c, t""")
def cutover_validation(spark, sf):
    docs = orders_docs(spark, sf)
    counts = C.counts(docs, docs.where("custkey % 97 <> 0"), {"match_all": {"match_all": {}}})
    return C.within(counts, [0, 100, 200, 100000])


@query("target_empty_check", f"{DOCS} select 'orders' as target, (select count(*) from docs) > 0 as rejected union all select 'empty', (select count(*) from docs where false) > 0")
def target_empty_check(spark, sf):
    docs = orders_docs(spark, sf)
    probe = lambda name, d: d.limit(1).agg((F.count("*") > 0).alias("rejected")).select(F.lit(name).alias("target"), "rejected")
    return probe("orders", docs).unionByName(probe("empty", docs.where(F.lit(False))))


@query("settings_capture_restore", """select c_custkey::varchar as idx, 'target.original.replicas' as key, case when c_custkey % 3 = 0 then '' else (c_custkey % 5)::varchar end as kept, case when c_custkey % 3 = 0 then null else (c_custkey % 5)::varchar end as restored from customer
union all select c_custkey::varchar, 'target.original.segment', c_mktsegment, c_mktsegment from customer""")
def settings_capture_restore(spark, sf):
    c = table(spark, sf, "customer")
    current = F.create_map(F.lit("replicas"), F.when(F.col("c_custkey") % 3 != 0, (F.col("c_custkey") % 5).cast("string")), F.lit("segment"), F.col("c_mktsegment"))
    return C.captured(c.select(F.col("c_custkey").cast("string").alias("idx"), current.alias("settings")))


@query("map_merge_latest", "select c_custkey::varchar as idx, 'phase' as key, 'new' as value from customer union all select c_custkey::varchar, 'segment', c_mktsegment from customer union all select c_custkey::varchar, 'extra', c_name from customer where c_custkey % 2 = 0")
def map_merge_latest(spark, sf):
    c = table(spark, sf, "customer")
    old = F.create_map(F.lit("phase"), F.lit("old"), F.lit("segment"), F.col("c_mktsegment"))
    new = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("phase"), F.lit("new"), F.lit("extra"), F.col("c_name"))).otherwise(F.create_map(F.lit("phase"), F.lit("new")))
    merged = C.put_all(old, new)
    return c.select(F.col("c_custkey").cast("string").alias("idx"), F.explode(merged).alias("key", "value"))


@query("alias_resolution", """select 'alias-' || n_nationkey as alias, 'idx-' || n_nationkey || case when n_nationkey % 2 = 0 then '-v2' else '' end as points_to from nation""")
def alias_resolution(spark, sf):
    n = table(spark, sf, "nation")
    aliases = n.select(F.concat(F.lit("alias-"), F.col("n_nationkey")).alias("alias"), F.concat(F.lit("idx-"), F.col("n_nationkey")).alias("points_to"))
    swaps = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("alias-"), F.col("n_nationkey")).alias("alias"), F.concat(F.lit("idx-"), F.col("n_nationkey"), F.lit("-v2")).alias("new"))
    return C.swapped(aliases, swaps)


@query("script_update", f"with {S.ORDERS} select _id, _routing, case when price > 1000 then upper(status) else status end as status, price * 1.5::double as price, custkey, priority as level, 'a;b' as note from docs")
def script_update(spark, sf):
    script = Script(source="status = case when price > :least then upper(status) else status end; price = price * cast(:by as double); note = 'a;b'; rename priority to level", params={"least": 1000, "by": 1.5})
    return transform_of(script)(orders_docs(spark, sf))


@query("script_rows", f"with {S.ORDERS} select _id || '-' || k as _id, _routing, status, price from docs, (select unnest(['x', 'y']) as k) where custkey % 3 <> 0")
def script_rows(spark, sf):
    scripts.STORED["fan out"] = "select concat(_id, '-', k) as _id, _routing, status, price from {rows} lateral view explode(split(:keys, ',')) as k where custkey % 3 <> 0"
    return transform_of(Script("stored", id="fan out", params={"keys": "x,y"}, script_context="rows"))(orders_docs(spark, sf))
