"""Row transforms as named builders: DataFrame -> DataFrame, all Column expressions that stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]


def identity(df: DataFrame) -> DataFrame:
    return df


def set_field(name: str, value) -> Transform:
    """A constant, a parameter or any Column."""
    return lambda df: df.withColumn(name, value if isinstance(value, Column) else F.lit(value))


def remove_field(name: str) -> Transform:
    return lambda df: df.drop(name)


def rename_field(old: str, new: str) -> Transform:
    """The new field is null if there is no old one."""
    return lambda df: df.withColumnRenamed(old, new) if old in df.columns else df.withColumn(new, F.lit(None).cast("string"))


def cast_long(name: str) -> Transform:
    """ANSI cast: fails the job on a value that is no number, as the script would."""
    return lambda df: df.withColumn(name, F.col(name).cast("long"))


def default(name: str, value) -> Transform:
    return lambda df: df.withColumn(name, F.coalesce(F.col(name), F.lit(value)))


def drop_where(predicate: Column) -> Transform:
    """No row for those that fit: the empty list of a 0..N transform."""
    return lambda df: df.where(~F.coalesce(predicate, F.lit(False)))


def fan_out(idents: Column, keep: list[str]) -> Transform:
    """A row for each id in the array."""
    return lambda df: df.select(F.explode(idents).alias("_id"), *keep)


def checked(df: DataFrame) -> DataFrame:
    """Rejects empty and null ids after a transform."""
    return df.withColumn("_id", F.when(F.length("_id") > 0, F.col("_id")).otherwise(F.raise_error(F.lit("empty _id after transform"))))


REGISTRY: dict[str, Transform] = {"identity": identity}


def named(name: str | None) -> Transform:
    """A registered transform; none, a blank name and `identity` leave rows as they are."""
    return REGISTRY[(name or "").strip() or "identity"]
