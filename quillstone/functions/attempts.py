"""Values that may fail in a row: null with a message in place of an error that would end the query.

An Attempt is a value and what went wrong with it, both plain Column expressions. with_attempts() puts the values into a
table and keeps the messages beside them; first_warning() and observed() tell the first of all rows and how many failed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: The column of messages, in the order of the formulas.
ERRORS = "__errors"


@dataclass(frozen=True)
class Attempt:
    value: Column
    #: A message, null where all went well.
    error: Column

    @staticmethod
    def of(value: Column) -> Attempt:
        """A value that can't fail."""
        return Attempt(value, F.lit(None).cast("string"))


def tried(value: Column, whole: Column, message: str, *shown: Column) -> Attempt:
    """A value from a try_ function that fails where it is null though all of its input is there; message is a format of what is shown."""
    return Attempt(value, F.when(value.isNull() & whole, F.format_string(message, *shown) if shown else F.lit(message)))


def divided(a: Column, b: Column) -> Attempt:
    return tried(F.try_divide(a, b), a.isNotNull() & b.isNotNull(), "division by zero")


def number(s: Column) -> Attempt:
    return tried(s.try_cast("double"), s.isNotNull(), "not a number: %s", s)


def day(s: Column) -> Attempt:
    """An ISO date."""
    return tried(s.try_cast("date"), s.isNotNull(), "not a date: %s", s)


def cast(c: Column, kind: str) -> Attempt:
    return tried(c.try_cast(kind), c.isNotNull(), f"not of type {kind}: %s", c.cast("string"))


def element(values: Column, index: Column) -> Attempt:
    """Counted from 0."""
    return tried(F.get(values, index), values.isNotNull() & index.isNotNull() & ((index < 0) | (index >= F.size(values))), "no element %s", index.cast("string"))


def then(f: Callable[..., Attempt | Column], *parts: Attempt) -> Attempt:
    """f of the parts' values; the first part's error counts, then f's own."""
    own = f(*[p.value for p in parts])
    own = own if isinstance(own, Attempt) else Attempt.of(own)
    error = F.coalesce(*[p.error for p in parts], own.error)
    return Attempt(F.when(error.isNull(), own.value), error)


def with_attempts(df: DataFrame, **formulas: Attempt) -> DataFrame:
    """The values as columns, and a row's messages as ERRORS, in the order of the formulas; steps may follow each other."""
    had = [F.col(ERRORS)] if ERRORS in df.columns else []
    new = F.filter(F.array(*[a.error for a in formulas.values()]), lambda e: e.isNotNull())
    return df.withColumns({name: F.when(a.error.isNull(), a.value) for name, a in formulas.items()} | {ERRORS: F.concat(*had, new)})


def _first(order: tuple[Column, ...]) -> Column:
    failed = F.size(ERRORS) > 0
    return F.min(F.when(failed, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(ERRORS)[0].alias("warning"))))["warning"]


def first_warning(df: DataFrame, *order: Column) -> DataFrame:
    """One row: warning, that of the first row in order that failed (null if none did), and failed, the number of rows with one."""
    return df.agg(_first(order).alias("warning"), F.count_if(F.size(ERRORS) > 0).alias("failed"))


def observed(df: DataFrame, *order: Column) -> tuple[DataFrame, Observation]:
    """The rows without their messages, and an observation whose get has warning and failed once the rows have been read."""
    seen = Observation()
    return df.observe(seen, _first(order).alias("warning"), F.count_if(F.size(ERRORS) > 0).alias("failed")).drop(ERRORS), seen
