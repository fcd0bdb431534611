"""Declarative views over files: filter trees, formulas, grouping, summaries.

A view is a Python structure whose leaves are Column expressions. Nulls sort last, texts sort naturally (accents and case
apart, digits by number), and a filter tree's `not` means none of its parts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.values import list_mean, list_sum, natural_key
from quillstone.operators.graph import ranked
from quillstone.operators.ranks import exact_median

Filter = Column | list | dict | None


def condition(f: Filter) -> Column:
    """A tree of and / or / not over conditions; a list is an and; nothing is true.

    Null is as good as false, so only below a not does it need a word; elsewhere conditions stay as scans understand them.
    """
    if f is None:
        return F.lit(True)
    if isinstance(f, list):
        return reduce(lambda a, b: a & b, map(condition, f), F.lit(True))
    if isinstance(f, dict):
        (kind, parts), = f.items()
        each = [condition(p) for p in (parts if isinstance(parts, list) else [parts])]
        if kind == "and":
            return reduce(lambda a, b: a & b, each, F.lit(True))
        some = reduce(lambda a, b: a | b, each, F.lit(False))
        if kind == "or":
            return some if each else F.lit(True)
        if kind == "not":
            return ~F.coalesce(some, F.lit(False))
        raise ValueError(f"no such filter: {kind}")
    return f


def with_formulas(df: DataFrame, formulas: dict[str, tuple[Callable[..., Column], tuple[str, ...]]]) -> DataFrame:
    """Columns by name from (function, names it takes), whatever order they are given in. A cycle is an error."""
    left = dict(formulas)
    while left:
        ready = [n for n, (_, needs) in left.items() if not set(needs) & set(left)]
        if not ready:
            raise ValueError(f"formulas need each other: {', '.join(sorted(left))}")
        df = df.withColumns({n: left[n][0](*[F.col(c) for c in left[n][1]]) for n in ready})
        for n in ready:
            del left[n]
    return df


def sort_key(c: Column, kind: str, descending: bool = False) -> Column:
    key = natural_key(c) if kind == "string" else c
    return key.desc_nulls_last() if descending else key.asc_nulls_last()


def _filled(c: Column, kind: str) -> Column:
    empty = c.isNull()
    if kind == "string":
        empty = empty | (c == "")
    if kind == "array":
        empty = empty | (F.size(c) == 0)
    return ~empty


#: Built-in summaries, by name: of a column and its kind. The spread is of the population, the sum of nothing is 0.
SUMMARIES: dict[str, Callable[[Column, str], Column]] = {
    "average": lambda c, k: F.avg(c),
    "sum": lambda c, k: F.coalesce(F.sum(c), F.lit(0.0)),
    "min": lambda c, k: F.min(c),
    "max": lambda c, k: F.max(c),
    "median": lambda c, k: F.median(c),
    "stddev": lambda c, k: F.stddev_pop(c),
    "range": lambda c, k: F.max(c) - F.min(c),
    "earliest": lambda c, k: F.min(c),
    "latest": lambda c, k: F.max(c),
    "checked": lambda c, k: F.count_if(F.coalesce(c, F.lit(False))),
    "unchecked": lambda c, k: F.count_if(~c),
    "empty": lambda c, k: F.count_if(~_filled(c, k)),
    "filled": lambda c, k: F.count_if(_filled(c, k)),
    "unique": lambda c, k: F.count_distinct(F.when(_filled(c, k), c)),
}


def summary(name: str, c: Column, kind: str) -> Column:
    return SUMMARIES[name.lower()](c, kind)


@dataclass(frozen=True)
class Values:
    """The values of a column of a segment, as the formula of a custom summary sees them: a list whose ends are aggregates.

    filter() and map() are expressions on each value, so a formula is summed up before the shuffle and no segment becomes a list.
    """

    value: Column
    keep: Column = field(default_factory=lambda: F.lit(True))

    def filter(self, f: Callable[[Column], Column]) -> Values:
        return Values(self.value, self.keep & F.coalesce(f(self.value), F.lit(False)))

    def map(self, f: Callable[[Column], Column]) -> Values:
        return Values(f(self.value), self.keep)

    def _kept(self) -> Column:
        return F.when(self.keep, self.value)

    @property
    def length(self) -> Column:
        """Nulls included."""
        return F.count_if(self.keep)

    def sum(self) -> Column:
        return F.coalesce(F.sum(self._kept()), F.lit(0))

    def mean(self) -> Column:
        return F.avg(self._kept())

    def min(self) -> Column:
        return F.min(self._kept())

    def max(self) -> Column:
        return F.max(self._kept())

    def unique(self) -> Column:
        """How many values there are, null as one of them."""
        return F.count_distinct(self._kept()) + F.coalesce(F.bool_or(self.keep & self.value.isNull()), F.lit(False)).cast("int")

    def contains(self, value: Column) -> Column:
        return F.coalesce(F.bool_or(self.keep & self.value.eqNullSafe(value)), F.lit(False))

    def any(self, f: Callable[[Column], Column]) -> Column:
        return self.filter(f).length > 0

    def all(self, f: Callable[[Column], Column]) -> Column:
        return self.filter(f).length == self.length


def custom_summary(formula: Callable[[Values], Column], c: Column) -> Column:
    """A formula over `values`, the values of the column: arithmetic on lengths, sums, means, extremes of filtered and mapped values, and the like."""
    return formula(Values(c))


def group_medians(rows: DataFrame, group: str, column: str, name: str) -> DataFrame:
    """group, name: the median of a number in each group; the mean of the two middle ones of an even count, nulls left out.

    The middle values are found by their places among the group's, which come from range partitions, so a group of any size is in no task as a whole.
    """
    placed = ranked(rows.where(F.col(column).isNotNull()).select(F.col(group).alias("__g"), F.col(column).cast("double").alias("v")), "__g", F.col("v"))
    sizes = placed.groupBy("__g").agg(F.count("*").alias("n")).withColumnRenamed("__g", "__of")
    middle = placed.join(sizes, F.col("__g").eqNullSafe(F.col("__of"))).where(F.col("k").between(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    return middle.groupBy(F.col("__g").alias(group)).agg(F.avg("v").alias(name))


@dataclass
class View:
    """filters apply to the source, own_filters to this view; sort and group are (column, kind, descending); names are shown in place of columns'."""

    columns: list[str]
    filters: Filter = None
    own_filters: Filter = None
    formulas: dict = field(default_factory=dict)
    sort: list[tuple[str, str, bool]] = field(default_factory=list)
    group: tuple[str, str, bool] | None = None
    group_order: list[str] | None = None
    limit: int = 0
    summaries: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)

    def source(self, files: DataFrame) -> DataFrame:
        df = files.where(condition(self.filters))
        return with_formulas(df, self.formulas).where(condition(self.own_filters)) if self.formulas else df.where(condition(self.own_filters))

    def shown(self, files: DataFrame) -> DataFrame:
        """The rows in order: by group, then by the sort keys, then by path."""
        keys = [sort_key(F.col(c), k, desc) for c, k, desc in ([self.group] if self.group else []) + self.sort]
        df = self.source(files).orderBy(*keys, "path")
        if self.limit > 0:
            df = df.limit(self.limit)
        if self.group and self.group_order is not None:
            df = df.where(F.lower(F.col(self.group[0]).cast("string")).isin([g.lower() for g in self.group_order]))
        return df

    def rows(self, files: DataFrame) -> DataFrame:
        return self.shown(files).select(*[F.col(c).alias(self.names.get(c, c)) for c in self.columns])

    def total(self, files: DataFrame) -> DataFrame:
        """total: the rows before the limit."""
        return self.source(files).agg(F.count("*").alias("total"))

    def groups(self, files: DataFrame, **more: Column) -> DataFrame:
        name, rows = self.group[0], self.shown(files) if self.limit > 0 or self.group_order is not None else self.source(files)
        medians = {n: c for n, (s, c, _) in self.summaries.items() if s.lower() == "median"}
        totals = {n: summary(s, F.col(c), k) for n, (s, c, k) in self.summaries.items() if n not in medians} | more
        out = rows.groupBy(name).agg(F.count("*").alias("n"), *[c.alias(n) for n, c in totals.items()])
        for n, c in medians.items():
            own = group_medians(rows, name, c, n).withColumnRenamed(name, "__group")
            out = out.join(own, F.col(name).eqNullSafe(F.col("__group")), "left").drop("__group")
        return out.select(name, "n", *self.summaries, *more)

    def totals(self, files: DataFrame) -> DataFrame:
        """One row of summaries. A median over all rows is worked out by exact_median(), as an aggregate would sort them in one task."""
        rows = self.shown(files) if self.limit > 0 else self.source(files)
        own = lambda s, c, k: F.lit(exact_median(rows, F.col(c))).cast("double") if s.lower() == "median" else summary(s, F.col(c), k)
        return rows.agg(*[own(*x).alias(n) for n, x in self.summaries.items()])


def related(edges: DataFrame, path: str, least: int = 1) -> DataFrame:
    """path, shared: notes that link to what this note links to, by how many such links."""
    own = edges.where(F.col("src") == path).select("dst").distinct()
    return edges.where(F.col("src") != path).join(own, "dst").groupBy(F.col("src").alias("path")).agg(F.count_distinct("dst").alias("shared")).where(F.col("shared") >= least)


__all__ = ["SUMMARIES", "Values", "View", "condition", "custom_summary", "group_medians", "list_mean", "list_sum", "related", "sort_key", "summary", "with_formulas"]
