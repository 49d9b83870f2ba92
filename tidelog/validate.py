"""What a start must pass, in this order; the first validator that finds something rejects, preconditions with all they find."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.routing import mode
from .operators import cutover, reconcile, state
from .requests import Rejected, Request
from .scripts import dry_run

if TYPE_CHECKING:
    from .engine import Engine


def request_shape(engine: Engine, request: Request) -> None:
    request.validate()


def indices_exist(engine: Engine, request: Request) -> None:
    for name in (request.source, request.target):
        if name not in engine.indices:
            raise Rejected(f"no such index: {name}")


def resolve_options(engine: Engine, request: Request) -> None:
    """Never rejects."""
    request.options = request.options.resolved(engine.settings)


def one_active(engine: Engine, request: Request) -> None:
    if engine.active(request.source):
        raise Rejected(f"{request.source} has an active migration")


def data_loss_consent(engine: Engine, request: Request) -> None:
    """Only where deletes are routed by topology, to shard counts that don't keep a document's shard."""
    source, options = engine.indices[request.source], request.options
    if engine.delete_strategy() == "SHARD_TOPOLOGY" and mode(source.shards, options.target_shards) == "BULK_API" and not options.data_loss_consent:
        what = "fewer" if options.target_shards < source.shards else "no multiple by a power of two"
        raise Rejected(f"from {source.shards} to {options.target_shards} shards ({what}): deletes may miss documents with their own routing; data_loss_consent is needed")


def preconditions(engine: Engine, request: Request) -> None:
    source, target, found = engine.indices[request.source], engine.indices[request.target], []
    for role, name, index in (("source", request.source, source), ("target", request.target, target)):
        if index.ready is not None and index.ready < index.shards:
            found.append(f"{role} {name} has {index.ready} of {index.shards} primaries ready")
    to = engine.aliases.get(request.alias)
    if request.alias in engine.indices:
        found.append(f"alias {request.alias} is the name of an index")
    elif to == request.target:
        found.append(f"alias {request.alias} points to the target already")
    elif to not in (None, request.source):
        found.append(f"alias {request.alias} points to another index")
    if engine.delete_strategy() == "SHARD_TOPOLOGY":
        found += topology_errors(engine, request)
    if found:
        raise Rejected("; ".join(found))


def topology_errors(engine: Engine, request: Request) -> list[str]:
    source, target, n = engine.indices[request.source], engine.indices[request.target], request.options.target_shards
    split = [f"{role} spreads a routing over {index.routing_partition_size} shards, so deletes can't be routed" for role, index in (("source", source), ("target", target)) if index.routing_partition_size > 1]
    if split:
        return split
    if mode(source.shards, n) == "BULK_API":
        return ["the target requires routing, but deletes are sent without"] if target.routing_required else []
    found = []
    if min(source.shards, n) > 1 and source.buckets() != target.buckets(n):
        found.append(f"source has {source.buckets()} routing buckets, target {target.buckets(n)}")
    try:
        reconcile.synthetic_keys(engine.spark, n, buckets=target.buckets(n))
    except ValueError as e:
        found.append(str(e))
    return found


def transform(engine: Engine, request: Request) -> None:
    dry_run(engine.indices[request.source].snapshot.select(*reconcile.COLUMNS), request, reconcile.PAYLOAD)


def plugin_consistency(engine: Engine, request: Request) -> None:
    """All nodes have the engine, in one version."""
    if engine.nodes is not None:
        row = state.consistency(engine.nodes).first()
        if row and not row["consistent"]:
            raise Rejected(f"nodes differ: {row['missing']} without the engine, {row['versions']} versions")


def target_empty(engine: Engine, request: Request) -> None:
    index = engine.indices[request.target]
    for rows in (index.documents, index.snapshot):
        if rows is not None and not rows.isEmpty():
            raise Rejected(f"{request.target} isn't empty")


def validation_query(engine: Engine, request: Request) -> None:
    """It must be a query of the source's and, where its rows are known, of the target's fields."""
    try:
        fits = cutover.predicate(request.options.validation_query)
        for index in (engine.indices[request.source], engine.indices[request.target]):
            if index.snapshot is not None:
                index.snapshot.limit(0).where(fits).collect()
    except Exception as e:
        raise Rejected(f"validation query: {str(e).splitlines()[0]}") from e


VALIDATORS = (request_shape, indices_exist, resolve_options, one_active, data_loss_consent, preconditions, transform, plugin_consistency, target_empty, validation_query)


def invalidated(migrations: DataFrame, primaries: DataFrame, progress: DataFrame) -> DataFrame:
    """migration_id, reason: active migrations whose source is gone, or an unfinished shard of which has no primary that is started and stays.

    migrations: migration_id, source_index, phase. primaries: source_index, shard, state (null: no primary). progress: migration_id, shard, phase.
    """
    skipped = (*state.TERMINAL, "FAILING", "CANCELLING", "COMPLETING")
    active = migrations.where(~F.col("phase").isin(*skipped)).select("migration_id", "source_index")
    done = progress.where("phase = 'COMPLETED'").select("migration_id", "shard")
    shards = active.join(primaries, "source_index", "left")
    unfinished = shards.join(done, ["migration_id", "shard"], "left_anti")
    wrong = F.when(F.col("shard").isNull(), "source is gone").when(F.col("state").isNull(), F.concat(F.lit("no primary of shard "), "shard")).when(F.col("state") != "STARTED", F.concat(F.lit("shard "), "shard", F.lit(" is "), "state"))
    told = unfinished.withColumn("reason", wrong).where("reason is not null")
    return told.groupBy("migration_id").agg(F.min_by("reason", F.coalesce("shard", F.lit(-1))).alias("reason"))


def local_primaries(shards: DataFrame, entries: DataFrame, node: str) -> DataFrame:
    """The node's primaries of indices that have a migration: source_index, shard."""
    own = shards.where((F.col("node") == node) & F.col("is_primary"))
    return own.join(entries.select("source_index").distinct(), "source_index", "left_semi").select("source_index", "shard")
