import json
import threading
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog import scripts
from tidelog.engine import Engine, Options, Permits, Rejected, Request, Script, Settings, Source
from tidelog.functions.routing import buckets_for, shard_of
from tidelog.functions.units import byte_sizes, durations, jittered
from tidelog.operators import reconcile as R
from tidelog.operators import state
from tidelog.operators.control import Adaptive, Aimd
from tidelog.records import SCHEMA as RECORD_SCHEMA
from tidelog.records import Records, reconciled
from tidelog.sinks import bulk
from tidelog.sinks.bulk import Exhausted, Writer
from tidelog.sources.fixtures import cutoffs, op_log
from tidelog.streaming.converge import NotConverging, Target, converge
from tidelog.streaming.status import StatusChannel

SCHEMA = "source_shard long, _id string, op string, seq_no long, _routing string, event_type string, value double, props string"


def ops(spark, *rows):
    return spark.createDataFrame([(0, i, op, seq, None, "t", float(v), None) for seq, op, i, v in rows], SCHEMA)


def test_recreated_document_keeps_its_last_value(spark):
    state = R.final_state(ops(spark, (-1, "INDEX", "doc1", 1), (1, "DELETE", "doc1", 0), (2, "INDEX", "doc1", 999)), 2)
    assert [r["value"] for r in state.collect()] == [999.0]


def test_mixed_replay_counts(spark):
    log = ops(spark, (10, "INDEX", "a", 1), (11, "NO_OP", "b", 1), (12, "DELETE", "a", 1), (13, "INDEX", "c", 1))
    assert tuple(R.counters(log).first())[1:] == (3, 1, 13)


def test_ranges_are_inclusive_and_guarded(spark):
    log = ops(spark, *((k, "INDEX", str(k), k) for k in range(5)))
    assert [R.seq_range(log, a, b).count() for a, b in ((1, 3), (3, 1), (-2, -1))] == [3, 0, 0]


def test_split_delete_accounts(spark):
    rows = R.accounted(R.split_targets(spark.createDataFrame([(1, 20)], "source_shard long, seq_no long"), 4), 4).orderBy("target_shard").collect()
    assert [(r["target_shard"], r["applied"], r["progress_seq"]) for r in rows] == [(4, 1, -1), (5, 0, -1), (6, 0, -1), (7, 0, 20)]


def test_synthetic_keys_cover_all_shards(spark):
    assert sorted(r["target_shard"] for r in R.synthetic_keys(spark, 9).collect()) == list(range(9))


def test_aimd_starts_at_its_largest_and_floors():
    c = Aimd(target=256 << 20, most=256 << 20, doc_bytes=float(1 << 20))
    assert c.sizes() == 256
    assert Aimd(target=1024, doc_bytes=10240.0).sizes() == 1
    c, seen = Aimd(target=8 << 20, least=2 << 20), []
    for _ in range(3):
        c.see(10, 1, 100, False)
        seen.append(c.target >> 20)
    assert seen == [4, 2, 2]


def test_adaptive_widens_when_stable():
    c = Adaptive()
    for _ in range(12):
        c.see(10.0, 10, 1000, True)
    assert c.width == 3


def test_status_words():
    assert state.wanted_phases("ALL") is None
    assert len(state.wanted_phases("active")) == 7
    for bad in ("", "a,,b", "nonsense"):
        with pytest.raises(ValueError):
            state.wanted_phases(bad)


LOG = ((5, "DELETE", "x", 0), (6, "CREATE", "z", 3))


def engine(spark, folder, log=LOG, **settings):
    e = Engine(spark, str(folder), Settings.of(settings))
    e.indices = {"a": Source(ops(spark, (-1, "INDEX", "x", 1), (-1, "INDEX", "y", 2)), ops(spark, *log)), "b": Source()}
    return e


def documents(e, name="b"):
    return {r["_id"]: r["value"] for r in e.indices[name].documents.collect()}


def test_engine_runs_a_migration(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.indices["b"].settings = {"refresh_interval": "30s"}
    assert e.start(Request("a", "b", "alias"))["accepted"]
    (record,) = e.status("a").collect()
    assert e.aliases == {"alias": "b"} and record["phase"] == "COMPLETED" and (record["source_count"], record["target_count"]) == (2, 2)
    assert [h["phase"] for h in record["history"]] == ["INITIALIZING", "ACTIVE", "PREPARING_TARGET", "CUTTING_OVER", "CATCHING_UP", "COMPLETING"]
    assert [(s["shard"], s["phase"], s["last_seq_no"]) for s in record["shards"]] == [(0, "COMPLETED", 6)]
    assert documents(e) == {"y": 2.0, "z": 3.0} and e.indices["a"].blocked
    assert e.indices["b"].settings == {"refresh_interval": "30s"} and e.leases.table().count() == 0
    assert e.list().count() == 1
    with pytest.raises(Rejected):
        e.cancel("a")
    with pytest.raises(Rejected):
        e.start(Request("a", "b", "alias"))  # the target isn't empty


def test_requests_decode(spark, tmp_path):
    body = {"source_index": "a", "target_index": "b", "alias": "c", "unknown": 1, "options": {"tolerance": 1, "remove_write_block": True, "target_shards": 2}, "transform_script": {"type": "inline", "source": "value = value * :by; props = concat('a;b', :s); rename event_type to kind", "params": {"by": 10, "s": "x"}, "script_context": None}}
    e = engine(spark, tmp_path)
    e.start(json.dumps(body))
    rows = sorted((r["_id"], r["value"], r["props"], r["kind"]) for r in e.indices["b"].documents.collect())
    assert rows == [("y", 20.0, "a;bx", "t"), ("z", 30.0, "a;bx", "t")] and not e.indices["a"].blocked
    assert Request.decode(Request.decode(body).encode()) == Request.decode(body)


@pytest.mark.parametrize(
    "request_, why",
    [
        (Request("", "b", ""), "source is missing; alias is missing"), (Request("a", "a", "c"), "the same"), (Request("a", "nowhere", "c"), "no such index"), (Request("a", "b", "b"), "name of an index"),
        (Request("a", "b", "c", options=Options(target_shards=3)), "data_loss_consent"), (Request("a", "b", "c", options=Options(tolerance=-1)), "tolerance"), (Request("a", "b", "c", Script()), "source"),
        (Request("a", "b", "c", Script("stored", id="nothing")), "no stored script"), (Request("a", "b", "c", Script(source="value = nofield + 1")), "fails"), (Request("a", "b", "c", Script(source="value = rand()")), "deterministic"),
        (Request("a", "b", "c", Script(source="_id = ''")), "empty _id"), (Request("a", "b", "c", Script(source="what is this")), "not a statement"), (Request("a", "b", "c", Script(source="x = 1", script_context="other")), "context"),
        (Request("a", "b", "c", options=Options(validation_query={"term": {"nofield": 1}})), "validation query"), (Request("a", "b", "c", options=Options(validation_query={"fuzzy": {"value": 1}})), "validation query"),
    ],
)
def test_engine_rejects(spark, tmp_path, request_, why):
    with pytest.raises(Rejected, match=why):
        engine(spark, tmp_path).start(request_)


def test_all_preconditions_are_told(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.indices["a"].ready, e.indices["b"].routing_partition_size, e.aliases["c"] = 0, 2, "elsewhere"
    with pytest.raises(Rejected) as told:
        e.start(Request("a", "b", "c"))
    assert all(x in str(told.value) for x in ("0 of 1 primaries", "another index", "spreads a routing"))
    e = engine(spark, tmp_path)
    e.indices["b"].routing_required = True
    with pytest.raises(Rejected, match="requires routing"):
        e.start(Request("a", "b", "c", options=Options(target_shards=3, data_loss_consent=True)))
    e = engine(spark, tmp_path)
    e.indices["a"].shards, e.indices["b"].routing_buckets = 2, 512
    with pytest.raises(Rejected, match="routing buckets"):
        e.start(Request("a", "b", "c", options=Options(target_shards=4)))


def test_consent_goes_by_the_strategy(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.versions = spark.createDataFrame([(3, 9), (4, 0)], "major int, minor int")
    e.start(Request("a", "b", "c", options=Options(target_shards=7)))
    assert documents(e) == {"y": 2.0, "z": 3.0} and {r["target_shard"] for r in e.indices["b"].documents.collect()} <= set(range(7))


def test_nodes_must_agree(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.nodes = spark.createDataFrame([("n1", "1.0"), ("n2", "1.1"), ("n3", None)], "node string, version string")
    with pytest.raises(Rejected, match="1 without the engine, 2 versions"):
        e.start(Request("a", "b", "c"))


def test_count_drift_rolls_back(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.indices["b"].settings, e.aliases = {"refresh_interval": "30s"}, {"c": "a"}
    with pytest.raises(Rejected, match="counts differ by 1"):
        e.start(Request("a", "b", "c", transform=lambda d: d.where("_id <> 'z'")))
    (record,) = e.status("a").collect()
    assert record["phase"] == "FAILED" and "counts differ" in record["reason"] and e.aliases == {"c": "a"}
    assert not e.indices["a"].blocked and e.indices["b"].settings == {"refresh_interval": "30s"} and e.leases.table().count() == 0
    e.start(Request("a", "b", "c"))  # a terminal record makes way
    assert e.list().count() == 2 and documents(e) == {"y": 2.0, "z": 3.0}


@pytest.mark.parametrize("aware", [False, True])
def test_deletes_are_transformed_only_when_asked(spark, tmp_path, aware):
    e = engine(spark, tmp_path)
    rekey = lambda d: d.withColumn("_id", F.concat(F.lit("t-"), "_id")).withColumn("value", F.col("value").cast("long"))
    e.start(Request("a", "b", "c", transform=rekey, options=Options(apply_to_deletes=aware, tolerance=1)))
    assert sorted(documents(e)) == (["t-y", "t-z"] if aware else ["t-x", "t-y", "t-z"])
    assert dict(e.indices["b"].documents.dtypes)["value"] == "bigint"


def test_scripts_may_drop_and_multiply_rows(spark, tmp_path):
    e = engine(spark, tmp_path)
    scripts.STORED["twice"] = "select * except (_id, tail), concat(_id, tail) as _id, tail from (select *, explode(array('', :tail)) as tail from {rows})"
    with pytest.raises(Rejected):
        e.start(Request("a", "b", "c", Script("stored", id="twice", params={"tail": "{2}"}, script_context="rows")))  # counts differ
    e.start(Request("a", "b", "c", Script("stored", id="twice", params={"tail": "{2}"}, script_context="rows"), Options(tolerance=9, target_shards=2)))
    assert {"y", "z", "y{2}", "z{2}"} <= set(documents(e))


def test_bad_rows_fail_the_migration(spark, tmp_path):
    e = engine(spark, tmp_path)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        e.start(Request("a", "b", "c", Script(source="value = cast(_id as int)", script_context="update") if False else (lambda d: d.withColumn("value", F.when(F.col("_id") == "z", F.col("_id").cast("int")).otherwise(1)))))
    assert e.record_of("a")["phase"] == "FAILED"


class Growing:
    """A log that has more to give each time it is read."""

    def __init__(self, spark, steps):
        self.spark, self.steps, self.reads = spark, steps, 0

    def __call__(self):
        self.reads += 1
        return ops(self.spark, *(x for step in self.steps[: self.reads] for x in step))


def test_convergence_and_its_limit(spark, tmp_path):
    steps = [[(10 * k + j, "INDEX", f"d{k}-{j}", k) for j in range(6)] for k in range(8)]
    e = engine(spark, tmp_path / "1")
    e.indices["a"].log = Growing(spark, steps)
    e.start(Request("a", "b", "c", options=Options(convergence_threshold=6)))
    assert len(documents(e)) == 2 + 48 and e.record_of("a")["rounds"] >= 1
    e = engine(spark, tmp_path / "2", max_convergence_rounds=2, convergence_threshold=0)
    e.indices["a"].log = Growing(spark, steps * 3)
    with pytest.raises(NotConverging):
        e.start(Request("a", "b", "c"))
    assert e.record_of("a")["phase"] == "FAILED"


def test_cancel_meets_a_running_migration(spark, tmp_path):
    e, gate = engine(spark, tmp_path), threading.Event()

    def log():
        gate.wait(60)
        return ops(spark, *LOG)

    e.indices["a"].log = log
    started = e.start(Request("a", "b", "c"), wait=False)
    with pytest.raises(Rejected, match="active migration"):
        e.start(Request("a", "b", "c"))
    assert e.cleanup_leases(dry_run=False).count() == 0  # held
    e.cancel("a")
    gate.set()
    e.wait(started["migration_id"])
    assert e.record_of("a")["phase"] == "CANCELLED" and not e.aliases and e.indices["b"].documents is None


class Gone(BaseException):
    """The driver goes away."""


def test_resume_after_the_driver_went_away(spark, tmp_path):
    for phase in ("ACTIVE", "CUTTING_OVER", "CATCHING_UP", "COMPLETING"):
        folder = tmp_path / phase
        first = engine(spark, folder)
        step = {"ACTIVE": "replayed", "CUTTING_OVER": "block", "CATCHING_UP": "catch_up", "COMPLETING": "complete"}[phase]

        def gone(*_):
            raise Gone

        setattr(first, step, gone)
        threading.excepthook, hook = lambda *_: None, threading.excepthook
        first.start(Request("a", "b", "c", Script(source="value = value + 1")))
        threading.excepthook = hook
        assert first.record_of("a")["phase"] == phase
        second = engine(spark, folder)
        (i,) = second.resume()
        second.wait(i)
        assert second.record_of("a")["phase"] == "COMPLETED" and documents(second) == {"y": 3.0, "z": 4.0} and second.aliases == {"c": "b"}
        assert second.resume() == []


def test_topology_change_fails_migrations(spark, tmp_path):
    e, gate = engine(spark, tmp_path), threading.Event()
    e.indices["a"].log = lambda: gate.wait(60) and ops(spark, *LOG)
    started = e.start(Request("a", "b", "c"), wait=False)
    primaries = lambda s: spark.createDataFrame([("a", 0, s)], "source_index string, shard long, state string")
    assert e.fail_invalidated(primaries("STARTED")) == []
    assert e.fail_invalidated(primaries("RELOCATING")) == [started["migration_id"]]
    gate.set()
    e.wait(started["migration_id"])
    assert e.record_of("a")["phase"] == "FAILED" and e.record_of("a")["reason"] == "shard 0 is RELOCATING"


def test_leases_and_shard_reports(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.leases.acquire("a", 0, "tide-migration-old", 5)
    e.leases.acquire("a", 0, "tide-migration-old", 7)
    e.leases.acquire("a", 1, "other", 1)
    assert [r["retaining_seq_no"] for r in e.leases.table().where("shard = 0").collect()] == [5]
    assert [tuple(r) for r in e.cleanup_leases().collect()] == [("a", 1, 0)] and e.leases.table().count() == 2
    assert [tuple(r) for r in e.cleanup_leases("a", dry_run=False).collect()] == [("a", 1, 0)] and e.leases.table().count() == 1
    e.start(Request("a", "b", "c"))
    i = e.record_of("a")["migration_id"]
    with pytest.raises(Rejected, match="can't go"):
        e.update_shard(i, 0, "BACKFILLING")
    assert e.clear_state(i, dry_run=False).count() == 1 and e.list().count() == 0


def test_record_schema_grows_only(spark, tmp_path):
    Records(spark, str(tmp_path)).files.write("_schema.json", json.dumps({"schema": T.StructType([T.StructField("migration_id", T.StringType()), T.StructField("mine", T.LongType())]).jsonValue(), "settings": {"number_of_shards": "5"}}))
    there = json.loads(Records(spark, str(tmp_path)).files.read("_schema.json"))
    assert {"mine", "phase"} <= {f["name"] for f in there["schema"]["fields"]} and there["settings"]["number_of_shards"] == "5"
    with pytest.raises(ValueError, match="phase is bigint"):
        reconciled(T.StructType([T.StructField("phase", T.LongType())]), RECORD_SCHEMA)


def test_settings_and_units(spark):
    s = Settings.of({"batch_max_bytes": "1.5mb", "liveness_timeout_ms": "2m", "replay_controller": "fixed", "remove_write_block": "true"})
    assert (s.batch_max_bytes, s.liveness_timeout_ms, s.remove_write_block) == (3 << 19, 120_000, True)
    for bad in ({"replay_controller": "adaptive"}, {"nothing": 1}, {"page_size": 0}, {"batch_max_bytes": "12 parsecs"}, {"batch_min_bytes": "1gb"}):
        with pytest.raises(ValueError):
            Settings.of(bad)
    texts = ["512kb", "1.5GB", "-1", "0", "10", "junk", None, "3b"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(byte_sizes(F.col("t"))).collect()]
    assert got == [512 << 10, 3 << 29, -1, 0, None, None, None, 3]
    assert [r[0] for r in spark.createDataFrame([("30s",), ("4h",), ("x",)], "t string").select(durations(F.col("t"))).collect()] == [30_000, 14_400_000, None]
    assert spark.range(1).select(jittered(F.lit(2000), F.lit(0.5))).first()[0] == 2250


def test_every_shard_count_and_hash_has_its_shards(spark):
    for n in (1, 7, 11, 32, 9):
        for kind in ("md5", "murmur3", "xxhash64"):
            got = {r[0] for r in spark.range(2000).select(shard_of(F.col("id").cast("string"), n, kind=kind)).distinct().collect()}
            assert got == set(range(n))
    assert buckets_for(7) == 896 and buckets_for(12) == 720
    assert sorted(r["target_shard"] for r in R.synthetic_keys(spark, 7).collect()) == list(range(7))


def test_deletes_without_a_synthetic_key_go_unrouted_once(spark):
    deletes = R.split_targets(spark.createDataFrame([(0, 5, "d")], "source_shard long, seq_no long, _id string"), 4)
    rows = R.routed_or_not(deletes, spark.createDataFrame([(1, "k1")], "target_shard long, routing string")).collect()
    assert sorted((r["target_shard"] or -1, r["routing"] or "") for r in rows) == [(-1, ""), (1, "k1")]


class Store:
    """Takes rows, fails as told: `faults` gives the result of the n-th request."""

    def __init__(self, faults):
        self.faults, self.requests, self.rows, self.lock = faults, 0, [], threading.Lock()

    def __call__(self, rows):
        with self.lock:
            n = self.requests
            self.requests += 1
            results = [self.faults(n, r) for r in rows]
            self.rows += [r for r, x in zip(rows, results) if x is None]
            return results


def test_failed_rows_come_back_at_the_head(spark):
    store = Store(lambda n, r: (429, "queue full") if n == 0 and r % 2 else None)
    slept = []
    told = Writer(store, Settings.of({"replay_controller": "fixed", "fixed_batch_docs": 4}), replay=True, sleep=slept.append, random=lambda: 0.0).write(range(10))
    assert store.rows == [0, 2, 1, 3, 4, 5, 6, 7, 8, 9] and told == {"sent": 10, "requests": 3, "retried": 2, "paused_ms": 2000} and slept == [2.0]
    with pytest.raises(Exhausted, match="not to be retried"):
        Writer(Store(lambda n, r: (400, "mapper error"))).write([1])
    with pytest.raises(Exhausted, match="3 requests failed"):
        Writer(Store(lambda n, r: (503, "")), Settings.of({"overload_max_failures": 3}), sleep=lambda s: None).write([1])


@pytest.mark.parametrize("kind", ["fixed", "adaptive_batch", "adaptive"])
def test_backfills_write_all_rows_with_any_controller(kind):
    store = Store(lambda n, r: (409, "") if r == 7 else (500, "") if n % 5 == 1 else None)
    told = Writer(store, Settings.of({"backfill_controller": kind, "fixed_batch_docs": 3, "batch_max_docs": 5, "backfill_concurrency": 4}), sleep=lambda s: None).write(range(60))
    assert sorted(store.rows) == [x for x in range(60) if x != 7] and told["sent"] == 60


def test_bulk_writes_from_spark(spark, tmp_path):
    folder = str(tmp_path)

    def connect():
        def send(rows):
            with open(f"{folder}/{rows[0]['target_shard']}", "a") as f:
                f.writelines(f"{r['seq_no']}\n" for r in rows)
            return [None] * len(rows)

        return send

    rows = spark.range(200).select((F.col("id") % 3).alias("target_shard"), F.col("id").alias("seq_no"))
    assert bulk.unsent(bulk.write(rows, connect, replay=True)).first()["sent"] == 200
    for shard in range(3):
        assert [int(x) for x in (tmp_path / str(shard)).read_text().split()] == list(range(shard, 200, 3))


def test_status_channel():
    sent, slept = [], []

    def send(x):
        sent.append(x)
        if x[0] == "barrier" and len(sent) < 3:
            raise OSError

    c = StatusChannel(send, heartbeat_s=0, sleep=slept.append)
    c.put("progress", 1)
    c.put("progress", 2)
    c.step()
    c.barrier("CONVERGED")
    c.barrier("COMPLETED")
    for _ in range(4):
        c.step()
    assert sent == [("progress", 2), ("barrier", "COMPLETED"), ("barrier", "COMPLETED"), ("heartbeat", None), ("heartbeat", None)] and len(slept) == 1


@pytest.mark.parametrize("files", [1, 3, 7])
def test_any_number_of_rounds_gives_one_state(spark, sf, tmp_path, files):
    log = op_log(spark, sf)
    rows = log.select(*R.COLUMNS)
    for k in range(files):
        rows.where(F.col("seq_no") % files == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    target = Target(spark, str(tmp_path / "target"), 6)
    target.apply(R.snapshot(log, cutoffs(log)).select(*R.COLUMNS))
    converge(stream, target, str(tmp_path / "checkpoint"))
    got = sorted((r["target_shard"], r["_id"], r["value"]) for r in target.rows().collect())
    want = sorted((r["target_shard"], r["_id"], r["value"]) for r in R.final_state(rows, 6).collect())
    assert got == want


def test_targets_survive_restarts_and_compaction(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(Target, "COMPACT", 2)
    log = op_log(spark, sf).select(*R.COLUMNS)
    for k in range(6):
        target = Target(spark, str(tmp_path), 6)  # as after a restart
        assert target.apply(log.where(F.col("seq_no") % 6 == k), k) > 0
        assert Target(spark, str(tmp_path), 6).apply(log.where(F.col("seq_no") % 6 == k), k) == 0  # passed over
    assert len(target.state["rounds"]) < 2 and target.state["applied"] == list(range(6))
    got = sorted((r["target_shard"], r["_id"], r["value"]) for r in Target(spark, str(tmp_path), 6).rows().collect())
    assert got == sorted((r["target_shard"], r["_id"], r["value"]) for r in R.final_state(log, 6).collect())


def test_permits_and_liveness(spark, tmp_path):
    e = engine(spark, tmp_path, permits_per_node=0)
    started = e.start(Request("a", "b", "c"), wait=False)
    while not e.record_of("a")["phase"] == "ACTIVE":
        time.sleep(0.1)
    seen = e.record_of("a")["shards"][0]["last_seen"]
    assert e.record_of("a")["shards"][0]["phase"] == "ACQUIRING_LEASE"  # it waits
    assert e.stale_shards(seen + 300_000).count() == 0 and [r["shard"] for r in e.stale_shards(seen + 300_001).collect()] == [0]
    e.permits.set(1)
    e.wait(started["migration_id"])
    assert e.record_of("a")["phase"] == "COMPLETED" and e.stale_shards(seen + 10**9).count() == 0
    order, paused = [], Permits(0)

    def worker(k):
        with paused.one(lambda: None):
            order.append(k)

    threads = [threading.Thread(target=worker, args=(k,)) for k in range(5)]
    for t in threads:
        t.start()
        time.sleep(0.05)
    paused.set(1)
    for t in threads:
        t.join()
    assert order == list(range(5))
