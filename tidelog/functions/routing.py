"""Hash routing as Column functions: effective routing, shard, mode. The usual hash is the md5 prefix, which any engine has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Buckets that shards divide where they can; 1, 2, 3, 4, 5, 6, 8, 9, 10 and 12 shards all do.
BUCKETS = 720
#: Buckets of other shard counts are the count times a power of two, up to so many.
MOST_BUCKETS = 1024

#: Hashes by name; each gives a long.
HASHES = {
    "md5": lambda v: F.conv(F.substring(F.md5(v), 1, 8), 16, 10).cast("long"),
    "murmur3": lambda v: F.hash(v).cast("long"),
    "xxhash64": lambda v: F.xxhash64(v),
}


def hash_of(value: Column, kind: str = "md5") -> Column:
    return HASHES[kind](value)


def buckets_for(shards: int) -> int:
    """The buckets of an index with so many shards: splitting or shrinking it by powers of two keeps them."""
    if BUCKETS % shards == 0:
        return BUCKETS
    buckets = shards
    while buckets * 2 <= MOST_BUCKETS:
        buckets *= 2
    return buckets


def shard_of(value: Column, shards: int, buckets: int | None = None, kind: str = "md5") -> Column:
    """Bucket by hash, then the run of buckets that makes a shard."""
    buckets = buckets or buckets_for(shards)
    if buckets % shards:
        raise ValueError(f"{shards} shards don't divide {buckets} buckets")
    return F.floor(F.pmod(hash_of(value, kind), F.lit(buckets)) / (buckets // shards)).cast("long")


def effective_routing(routing: Column, ident: Column) -> Column:
    return F.coalesce(routing, ident)


def mode(source: int, target: int) -> str:
    """mode_of for two numbers."""
    power = lambda a, b: a % b == 0 and (a // b) & (a // b - 1) == 0
    return "SAME" if source == target else "SPLIT" if target > source and power(target, source) else "SHRINK" if source > target and power(source, target) else "BULK_API"


def mode_of(source: Column, target: Column) -> Column:
    """SAME, SPLIT or SHRINK where the shard counts are equal or a power of two apart, else BULK_API."""
    power = lambda f: f.bitwiseAND(f - 1) == 0
    grown, shrunk = F.floor(target / source).cast("long"), F.floor(source / target).cast("long")
    return (
        F.when(source == target, "SAME")
        .when((target > source) & (target % source == 0) & power(grown), "SPLIT")
        .when((source > target) & (source % target == 0) & power(shrunk), "SHRINK")
        .otherwise("BULK_API")
    )
