"""Column expressions: keys, flags, labels, selections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: A secret that begins so is none. Fixed value.
PLACEHOLDER = "your-"


def key_or_unknown(column: Column, unknown: str = UNKNOWN) -> Column:
    """The key as text; null and the empty text are `unknown`, white space is kept."""
    return F.coalesce(F.nullif(column.cast("string"), F.lit("")), F.lit(unknown))


def truthy_text(column: Column) -> Column:
    """Whether a text is neither null nor empty; white space and "0" are true."""
    return F.coalesce(column != "", F.lit(False))


def truthy_number(column: Column) -> Column:
    return F.coalesce(column != 0, F.lit(False))


def same_sequence(actual: Column, expected: Column) -> Column:
    """Whether two arrays agree in order too; null where `actual` is null or empty."""
    return F.when(F.size(F.coalesce(actual, F.array().cast("array<string>"))) > 0, actual == expected)


def is_ready(*flags: Column) -> Column:
    """'ready' if all flags are true, else 'degraded'."""
    every = F.lit(True)
    for flag in flags:
        every = every & F.coalesce(flag, F.lit(False))
    return F.when(every, F.lit("ready")).otherwise(F.lit("degraded"))


def toggled(items: Column, item: Column) -> Column:
    """The array without the item if it holds it, else with it at the end."""
    return F.when(F.array_contains(items, item), F.array_remove(items, item)).otherwise(F.array_append(items, item))


def short_commit(commit: Column, size: int = 8, missing: str = "Not connected") -> Column:
    return F.coalesce(F.substring(commit, 1, size), F.lit(missing))


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def family_label(family: Column) -> Column:
    """The solver family has a label of its own, all others are baselines."""
    return F.when(family == "sag", "SAG").otherwise("BASE")


def status_label(status: Column) -> Column:
    return F.when(status == "ready", "System ready").otherwise("Checking system")


def availability_label(available: Column, yes: str = "Available", no: str = "Unavailable") -> Column:
    return F.when(F.coalesce(available, F.lit(False)), yes).otherwise(no)


def has_secret(column: Column) -> Column:
    """Whether a secret is set and isn't a placeholder; the secret itself is never returned."""
    return ~F.coalesce(F.nullif(column, F.lit("")), F.lit(PLACEHOLDER)).startswith(PLACEHOLDER)


def list_length(items: Column) -> Column:
    """How many items a list holds; null holds none."""
    return F.coalesce(F.array_size(items), F.lit(0))
