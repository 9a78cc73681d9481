"""Casts, time formats, schemas given as text, and a stopwatch."""

from __future__ import annotations

import time

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = (("d", 86400.0), ("h", 3600.0), ("min", 60.0), ("s", 1.0), ("ms", 1e-3), ("µs", 1e-6), ("ns", 1e-9))


def to_text(c: Column) -> Column:
    return c.cast("string")


def to_int(c: Column) -> Column:
    """Wide integers keep their low 32 bits; text that is no number is an error under ANSI mode."""
    low = F.pmod(c.cast("bigint"), F.lit(2**32))
    return F.when(low >= 2**31, low - 2**32).otherwise(low).cast("int")


def to_long(c: Column) -> Column:
    return c.cast("bigint")


def to_boolean(c: Column) -> Column:
    """Only 'true', in any case, is true."""
    return F.coalesce(F.lower(c.cast("string")) == "true", F.lit(False))


def to_list(c: Column) -> Column:
    return F.array(c)


def format_millis(c: Column, pattern: str = "yyyyMMdd_HHmmss") -> Column:
    """Epoch milliseconds as text, in the session's time zone."""
    return F.date_format(F.timestamp_millis(c), pattern)


def split_csv(c: Column) -> Column:
    """Fields between commas, without the empty ones at the end."""
    return F.split(F.regexp_replace(c, ",+$", ""), ",")


def split_fields(c: Column, punctuation: str = "") -> Column:
    """Fields between white space, or between the punctuation and white space; trimmed."""
    pattern = r"\s+" if not punctuation else rf"\Q{punctuation}\E\s+"
    return F.transform(F.split(F.trim(c), pattern), lambda x: F.trim(x))


def parse_schema(text: str) -> list[str]:
    return [x.strip() for x in text.split(",")]


def field_index(schema: str, field: str) -> int:
    names = parse_schema(schema)
    if field not in names:
        raise ValueError(f"no field {field!r} in {schema!r}")
    return names.index(field)


def field_index_column(schema: Column, field: Column) -> Column:
    """0-based place of the field in a schema given as text; -1 if absent."""
    return (F.array_position(F.transform(F.split(schema, ","), lambda x: F.trim(x)), field) - 1).cast("int")


def random_alphanumeric(length: int, seed: int) -> Column:
    return F.randstr(F.lit(length), F.lit(seed))


class Stopwatch:
    """Elapsed time, stopped and started again; `str` gives it in the largest unit that fits."""

    def __init__(self, started: bool = True):
        self.before, self.began = 0.0, time.monotonic() if started else None

    def start(self) -> Stopwatch:
        self.began = self.began if self.began is not None else time.monotonic()
        return self

    def stop(self) -> Stopwatch:
        self.before, self.began = self.elapsed(), None
        return self

    def reset(self) -> Stopwatch:
        self.before, self.began = 0.0, None
        return self

    def elapsed(self, unit: str = "s") -> float:
        seconds = self.before + (time.monotonic() - self.began if self.began is not None else 0.0)
        return seconds / dict(UNITS)[unit]

    def __str__(self) -> str:
        seconds = self.elapsed()
        name, size = next((u for u in UNITS if seconds >= u[1]), UNITS[-1])
        return f"{seconds / size:.4g} {name}"
