"""Ordered folds over bulk outcomes, packing, retries and rejections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import control as C
from ..sources.fixtures import outcomes, table
from . import sql as S
from .registry import query

OUT = f"with recursive {S.OUTCOMES}"
FIXED = f"{C.START_DOC_BYTES}::double"


def recursion(columns: str, first: str, step: str) -> str:
    """A state per writer and tick k: `first` names the start values, `step` the next ones from s (state) and o (outcome)."""
    return f"""{OUT}, t as (select writer, 0::bigint as k, {first} from (select distinct writer from outcomes)
union all select o.writer, o.k, {step} from t s join outcomes o on o.writer = s.writer and o.k = s.k + 1),
ends as (select * from t where k = (select count(*) from outcomes o where o.writer = t.writer))"""


EACH = "(o.bytes::double / o.items)"


def doc_size(old: str) -> str:
    return f"case when o.items > 0 and o.bytes > 0 then (1 - case when {EACH} > {old} * 1.5 then 0.5 else 0.2 end::double) * {old} + case when {EACH} > {old} * 1.5 then 0.5 else 0.2 end::double * {EACH} else {old} end"


@query("ewma_doc_bytes", f"""with recursive d as (select source, n_chars::double as bytes, row_number() over (partition by source order by doc_id) as k from documents),
t as (select source, 0::bigint as k, {FIXED} as e from (select distinct source from d)
union all select d.source, d.k, case when d.bytes > 0 then (1 - case when d.bytes > s.e * 1.5 then 0.5 else 0.2 end::double) * s.e + case when d.bytes > s.e * 1.5 then 0.5 else 0.2 end::double * d.bytes else s.e end
  from t s join d on d.source = s.source and d.k = s.k + 1)
select source, round(e, 4) as doc_bytes from t where k = (select count(*) from d where d.source = t.source)""")
def ewma_doc_bytes(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", F.col("n_chars").cast("double").alias("bytes"), F.lit(1).alias("items"))
    return C.doc_sizes(docs, "source", "doc_id").select("source", F.round("state", 4).alias("doc_bytes"))


NOW = "case when o.bytes > 0 and o.took > 0 then o.bytes::double / o.took else 0::double end"


@query("ewma_throughput", recursion("e", "0::double as e", f"case when not o.success then s.e when s.e <= 0 then {NOW} else 0.7::double * s.e + 0.3::double * {NOW} end") + " select writer, round(e, 4) as throughput from ends")
def ewma_throughput(spark, sf):
    return C.throughputs(outcomes(spark, sf), "writer", "tick").select("writer", F.round("state", 4).alias("throughput"))


@query("latency_gradient", recursion("", "0::double as a, 0::double as b, 0::bigint as n", """case when o.took < 0 then s.a when s.n = 0 then o.took / o.items else 0.5::double * (o.took / o.items) + 0.5::double * s.a end,
  case when o.took < 0 then s.b when s.n = 0 then o.took / o.items else 0.1::double * (o.took / o.items) + 0.9::double * s.b end, s.n + case when o.took < 0 then 0 else 1 end""") + """
select writer, round(a, 6) as short, round(b, 6) as long, n as samples, n >= 5 as warm, round(case when b <= 0 then 1 else a / b end, 4) as gradient from ends""")
def latency_gradient(spark, sf):
    rows = outcomes(spark, sf).withColumn("latency", F.col("took") / F.col("items"))
    g = C.gradients(rows, "writer", "tick", "latency")
    ratio = F.when(F.col("long") <= 0, 1.0).otherwise(F.col("short") / F.col("long"))
    return g.select("writer", F.round("short", 6).alias("short"), F.round("long", 6).alias("long"), "samples", (F.col("samples") >= 5).alias("warm"), F.round(ratio, 4).alias("gradient"))


@query("backoff_trace", recursion("", "0::bigint as level, 0::bigint as failures, 0::bigint as pause, false as exhausted", """case when o.success then greatest(s.level - 1, 0) else s.level + 1 end, case when o.success then 0 else s.failures + 1 end,
  case when o.success then s.pause else least(2000 * (1 << least(s.level, 20)::int), 120000) end, s.exhausted or (not o.success and s.failures + 1 >= 50)""") + " select writer, level, failures, pause, exhausted from ends")
def backoff_trace(spark, sf):
    return C.backoffs(outcomes(spark, sf), "writer", "tick")


GROW = f"least(tgt + greatest(trunc(tgt * 0.2::double)::bigint, {C.STEP_BYTES}), {C.MAX_BYTES})"
#: The controller as successive projections: estimate, trial, then growth; one recursive step each outcome.
AIMD = f"""{OUT}, t as (
select writer, 0::bigint as k, 0::bigint as tick, {C.MAX_BYTES}::bigint as target, {FIXED} as e, 0::double as last, {C.MAX_BYTES}::bigint as before, 0::bigint as ok, 0::bigint as cooldown, false as trial from (select distinct writer from outcomes)
union all
select writer, k, tick, case when fail then greatest(target // 2, {C.MIN_BYTES}) when grows then {GROW} else tgt end,
  e, case when fail then last when last <= 0 then now else 0.7::double * last + 0.3::double * now end, case when grows then tgt else before end,
  case when fail or grows then 0 else ok + 1 end, case when fail then {C.COOLDOWN} when cd > 0 then cd - 1 else 0 end, grows
from (select *, not fail and cd = 0 and ok + 1 >= {C.THRESHOLD} and tgt < {C.MAX_BYTES} as grows from (
  select *, case when back then before else target end as tgt, case when back then {C.COOLDOWN} else cooldown end as cd from (
    select *, not fail and trial and last > 0 and now <= last * (1::double - 0.1::double) as back from (
      select o.writer, o.k, o.tick, s.target, {doc_size('s.e')} as e, s.last, s.before, s.ok, s.cooldown, s.trial, not o.success as fail, {NOW} as now
      from t s join outcomes o on o.writer = s.writer and o.k = s.k + 1)))))
select writer, tick, target, greatest(1, least(trunc(target / greatest(e, 1))::bigint, {C.MAX_DOCS})) as docs, cooldown, trial from t where k > 0"""


@query("aimd_trace", AIMD)
def aimd_trace(spark, sf):
    return C.aimd_trace(outcomes(spark, sf))


LAT = "(o.took / o.items)"
ADAPTIVE = f"""{OUT}, t as (
select writer, 0::bigint as k, 0::bigint as tick, {C.MAX_BYTES}::bigint as target, 1::bigint as width, 0::bigint as stable, 0::double as a, 0::double as b, 0::bigint as n from (select distinct writer from outcomes)
union all
select writer, k, tick, case when down then greatest(target // 2, {C.MIN_BYTES}) when up and width >= 8 then least(target + greatest(trunc(target * 0.2::double)::bigint, {C.STEP_BYTES}), {C.MAX_BYTES}) else target end,
  case when down then greatest(1, width - 1) when up and width < 8 then width + 1 else width end, case when down or up then 0 else stable + 1 end, a, b, n
from (select *, not down and n >= 5 and stable + 1 >= 5 as up from (
  select *, fail or (n >= 5 and case when b > 0 then a / b else 1 end > 1.5) as down from (
    select o.writer, o.k, o.tick, s.target, s.width, s.stable, case when s.n = 0 then {LAT} else 0.5::double * {LAT} + 0.5::double * s.a end as a,
      case when s.n = 0 then {LAT} else 0.1::double * {LAT} + 0.9::double * s.b end as b, s.n + 1 as n, not o.success as fail
    from t s join outcomes o on o.writer = s.writer and o.k = s.k + 1))))
select writer, tick, target, width, stable, least(2 * target, {C.MAX_BYTES}) as most_bytes from t where k > 0"""


@query("adaptive_trace", ADAPTIVE)
def adaptive_trace(spark, sf):
    return C.adaptive_trace(outcomes(spark, sf))


@query("batch_packing", """with recursive d as (select source, n_chars as size, row_number() over (partition by source order by doc_id) as k from documents),
t as (select source, k, 0::bigint as batch, 1::bigint as docs, size as bytes from d where k = 1
union all select d.source, d.k, s.batch + case when s.docs >= 10 or s.bytes >= 20000 then 1 else 0 end, case when s.docs >= 10 or s.bytes >= 20000 then 1 else s.docs + 1 end,
  case when s.docs >= 10 or s.bytes >= 20000 then d.size else s.bytes + d.size end from t s join d on d.source = s.source and d.k = s.k + 1)
select source, batch, max(docs) as docs, max(bytes) as bytes from t group by 1, 2""")
def batch_packing(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", F.col("n_chars").alias("size"))
    return C.packed(docs, "source", "doc_id", "size", 10, 20000)


@query("consecutive_failures", f"""with {S.OUTCOMES}, g as (select *, k - sum(case when success then 0 else 1 end) over (partition by writer order by k) as island from outcomes),
runs as (select writer, island, count(*) as n from g where not success group by all)
select writer, max(n) as longest, max(n) >= 3 as failed from runs group by 1""")
def consecutive_failures(spark, sf):
    order = Window.partitionBy("writer").orderBy("tick")
    marked = outcomes(spark, sf).select("writer", "success", F.sum(F.col("success").cast("int")).over(order).alias("island"))
    runs = marked.where("not success").groupBy("writer", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("writer").agg(F.max("n").alias("longest"), (F.max("n") >= 3).alias("failed"))


CODES = "(case event_id % 7 when 0 then 429 when 1 then 409 when 2 then 400 when 3 then 404 when 4 then 500 else 503 end)"
KIND = f"case when {CODES} = 409 then 0 when {CODES} = 429 then 3 when {CODES} between 400 and 499 then 2 else 1 end"


@query("rejection_by_batch", f"""select user_id as writer, ['NONE', 'TRANSIENT', 'FATAL', 'OVERLOAD'][max(case when event_type = 'error' then {KIND} else 0 end) + 1] as kind, count(*) as items from events group by 1""")
def rejection_by_batch(spark, sf):
    e = table(spark, sf, "events")
    code = F.element_at(F.array(*map(F.lit, (429, 409, 400, 404, 500, 503, 503))), (F.col("event_id") % 7 + 1).cast("int"))
    kind = F.when(F.col("event_type") == "error", C.rejection(code, F.lit(None).cast("string"), F.lit(False))).otherwise("NONE")
    ranks = F.create_map(*[F.lit(x) for kv in C.RANKS.items() for x in kv])
    # The worst kind is the largest rank: a number, so that batches are combined before the shuffle.
    worst = e.groupBy(F.col("user_id").alias("writer")).agg(F.max(F.element_at(ranks, kind)).alias("rank"), F.count("*").alias("items"))
    return worst.select("writer", F.element_at(F.array(*map(F.lit, C.RANKS)), F.col("rank") + 1).alias("kind"), "items")


CASES = (
    (1, 429, "", False), (2, 409, "", False), (3, 400, "mapper error", False), (4, 500, "", False), (5, 503, "Queue full", False), (6, 400, "execution REJECTED", False),
    (7, 429, "", True), (8, 413, "Request Entity Too Large", False), (9, 404, "", False), (10, 200, "no signal", False),
)


@query("rejection_classify", "with t as (select unnest([[1, 3], [2, 0], [3, 2], [4, 1], [5, 3], [6, 3], [7, 1], [8, 3], [9, 2], [10, 1]]) as p) select p[1]::bigint as n, ['NONE', 'TRANSIENT', 'FATAL', 'OVERLOAD'][p[2] + 1] as kind from t")
def rejection_classify(spark, sf):
    cases = spark.createDataFrame(CASES, "n long, status int, message string, unavailable boolean")
    return cases.select("n", C.rejection(F.col("status"), F.col("message"), F.col("unavailable")).alias("kind"))


@query("retry_schedule", "select attempt::bigint as attempt, (1 << attempt)::bigint * 10000 as delay_ms, attempt < 2 as retried from range(0, 4) t(attempt)")
def retry_schedule(spark, sf):
    return spark.range(4).select(F.col("id").alias("attempt"), (F.pow(F.lit(2), "id") * 10000).cast("long").alias("delay_ms"), (F.col("id") < 2).alias("retried"))


@query("bench_throughput", f"""with {S.OUTCOMES} select writer, sum(items)::bigint as docs, sum(bytes)::bigint as bytes, round(sum(items) * 1000 / greatest(sum(took), 1), 2) as docs_per_s from outcomes where success group by 1""")
def bench_throughput(spark, sf):
    ok = outcomes(spark, sf).where("success").groupBy("writer").agg(F.sum("items").alias("docs"), F.sum("bytes").alias("bytes"), F.sum("took").alias("took"))
    return ok.select("writer", "docs", "bytes", F.round(F.col("docs") * 1000 / F.greatest("took", F.lit(1)), 2).alias("docs_per_s"))
