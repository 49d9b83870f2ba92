"""Cutover: counts on both sides, tolerance, settings kept and restored, pointer swap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def predicate(query: dict | None) -> Column:
    """The validation query: match_all, term, terms, exists, range and bool; an empty one matches all."""
    if not query:
        return F.lit(True)
    ((kind, body),) = query.items()
    if kind == "match_all":
        return F.lit(True)
    if kind == "exists":
        return F.col(body["field"]).isNotNull()
    if kind == "bool":
        every = lambda key, join, start: reduce(join, [predicate(q) for q in body.get(key, [])], start)
        both, either = (lambda a, b: a & b), (lambda a, b: a | b)
        any_of = every("should", either, F.lit(False)) if body.get("should") else F.lit(True)
        return every("must", both, F.lit(True)) & every("filter", both, F.lit(True)) & any_of & ~F.coalesce(every("must_not", either, F.lit(False)), F.lit(False))
    ((field, value),) = body.items()
    if kind == "term":
        return F.col(field) == (value["value"] if isinstance(value, dict) else value)
    if kind == "terms":
        return F.col(field).isin(*value)
    if kind == "range":
        tests = {"gt": F.col(field).__gt__, "gte": F.col(field).__ge__, "lt": F.col(field).__lt__, "lte": F.col(field).__le__}
        return reduce(lambda a, b: a & b, [tests[k](v) for k, v in value.items()])
    raise ValueError(f"query form not supported: {kind}")


def counts(source: DataFrame, target: DataFrame, queries: dict[str, dict]) -> DataFrame:
    """query, source, target: exact counts; one scan of each side for all queries."""

    def one(df: DataFrame, name: str) -> DataFrame:
        row = df.agg(*(F.count_if(F.coalesce(predicate(q), F.lit(False))).alias(f"__{k}") for k, q in enumerate(queries.values())))
        return row.select(F.explode(F.array(*(F.struct(F.lit(q).alias("query"), F.col(f"__{k}").alias(name)) for k, q in enumerate(queries)))).alias("f")).select("f.*")

    return one(source, "source").join(one(target, "target"), "query").select("query", "source", "target")


def within(counts: DataFrame, tolerances: list[int]) -> DataFrame:
    """Whether the counts differ by at most the tolerance, itself included."""
    rows = counts.select(F.explode(F.array(*(F.lit(t).cast("long") for t in tolerances))).alias("tolerance"), "source", "target")
    difference = F.abs(F.col("source") - F.col("target"))
    return rows.withColumn("difference", difference).withColumn("passed", difference <= F.col("tolerance"))


def captured(settings: DataFrame, prefix: str = "target.original.") -> DataFrame:
    """idx, key, kept, restored: settings under the prefix; the empty string stands for null, which restores the default."""
    kept = F.transform_keys(F.transform_values("settings", lambda k, v: F.coalesce(v, F.lit(""))), lambda k, v: F.concat(F.lit(prefix), k))
    return settings.select("idx", F.explode(kept).alias("key", "kept")).withColumn("restored", F.when(F.col("kept") != "", F.col("kept")))


def put_all(old: Column, new: Column) -> Column:
    """Map of both; for keys in both the new value."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def swapped(aliases: DataFrame, swaps: DataFrame) -> DataFrame:
    """alias, points_to after all swaps at once."""
    return aliases.join(swaps, "alias", "left").select("alias", F.coalesce("new", "points_to").alias("points_to"))
