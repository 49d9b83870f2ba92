"""Byte sizes and durations as texts, for settings and as Columns, and jitter."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of byte sizes (powers of 1024) and of durations (in milliseconds).
SIZES = {"b": 1, "kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30, "tb": 1 << 40, "pb": 1 << 50}
TIMES = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
FORM = r"^\s*(-?[0-9]+(?:\.[0-9]+)?)\s*([a-z]*)\s*$"


def _parsed(text: str | int, units: dict[str, int], kind: str) -> int:
    if isinstance(text, int):
        return text
    found = re.match(FORM, text.lower())
    if found and found[1] in ("-1", "0") and not found[2]:  # without a unit: no bound, and nothing
        return int(found[1])
    if not found or found[2] not in units:
        raise ValueError(f"{text!r} is no {kind}")
    return int(float(found[1]) * units[found[2]])


def byte_size(text: str | int) -> int:
    """`512kb`, `1.5gb`; plain numbers are bytes; -1 and 0 need no unit."""
    return _parsed(text, SIZES, "byte size")


def duration_ms(text: str | int) -> int:
    """`30s`, `4h`; plain numbers are milliseconds; -1 and 0 need no unit."""
    return _parsed(text, TIMES, "duration")


def _column(text: Column, units: dict[str, int]) -> Column:
    unit = F.regexp_extract(F.lower(text), FORM, 2)
    scale = F.try_element_at(F.create_map(*[F.lit(x) for kv in units.items() for x in kv]), unit)
    number = F.regexp_extract(F.lower(text), FORM, 1)
    plain = F.when((unit == "") & number.isin("-1", "0"), number.try_cast("long"))
    return F.coalesce(plain, (number.try_cast("double") * scale).try_cast("long"))


def byte_sizes(text: Column) -> Column:
    """As byte_size; null for what is none."""
    return _column(text, SIZES)


def durations(text: Column) -> Column:
    """As duration_ms; null for what is none."""
    return _column(text, TIMES)


def jittered(pause: Column, random: Column) -> Column:
    """The pause and up to a quarter of it; random is from 0 to 1 (F.rand() outside of tests)."""
    return (pause + F.floor(pause * 0.25 * random)).cast("long")
