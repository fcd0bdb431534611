"""Table queries: an ordered table of notes and the steps that follow each other on it.

Order is part of the result, so it is kept as sort keys beside the rows; nothing is sorted until rows are cut off or
returned. Steps run in the order in which they are called: a where after a limit filters what the limit kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.functions.values import unnest
from quillstone.operators.graph import ranked

#: Rows that cross to a caller that asks for a capped result.
CAP = 2000
#: Items shown for a day of a calendar, and rows of a group in one row of a nested table.
DAY_ITEMS, BLOCK = 30, 10_000


@dataclass(frozen=True)
class Rows:
    df: DataFrame
    #: Sort keys, most important first; they end in a unique one.
    order: tuple[Column, ...]

    @staticmethod
    def of(df: DataFrame, *unique: str) -> Rows:
        return Rows(df, tuple(F.col(c).asc() for c in unique or ("path",)))

    def where(self, condition: Column) -> Rows:
        return replace(self, df=self.df.where(condition))

    def sort(self, *keys: Column) -> Rows:
        """Stable: the order so far breaks ties. Keys are columns with asc() (nulls first) or desc() (nulls last)."""
        return replace(self, order=(*keys, *self.order))

    def limit(self, n: int) -> Rows:
        return replace(self, df=self.df.orderBy(*self.order).limit(n))

    def with_columns(self, **columns: Column) -> Rows:
        return replace(self, df=self.df.withColumns(columns))

    def flatten(self, name: str, value: Column) -> Rows:
        """A row for each element of a list: none for an empty one, one for null."""
        return replace(self, df=self.df.select("*", unnest(value).alias(name)))

    def group(self, name: str, key: Column, **aggregates: Column) -> Rows:
        """Groups with aggregates of their rows, which Spark sums up before the shuffle. Ordered by the key."""
        return Rows.of(self.df.groupBy(key.alias(name)).agg(*[c.alias(k) for k, c in aggregates.items()] or [F.count("*").alias("length")]), name)

    def group_rows(self, name: str, key: Column, *columns: str, size: int = BLOCK) -> Rows:
        """Groups with their rows as a nested table, in order of first appearance.

        A group of more than `size` rows is dealt over several, which follow each other, numbered by block: places within a
        group come from range partitions, so no group is in one task or one row however large it is.
        """
        placed = ranked(self.df.withColumn("__g", key), "__g", *self.order)
        blocks = placed.groupBy(F.col("__g").alias(name), F.floor(F.col("k") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("k", *columns))).alias("rows"))
        blocks = blocks.withColumn("rows", F.transform("rows", lambda r: r.dropFields("k")))
        heads = placed.where("k = 0").select(F.col("__g").alias("__of"), F.struct(*columns).alias("__first"))
        return Rows(blocks.join(heads, F.col(name).eqNullSafe(F.col("__of"))).drop("__of"), (F.col("__first").asc(), F.col("block").asc()))

    def table(self, **columns: Column) -> DataFrame:
        return self.df.orderBy(*self.order).select(*[c.alias(k) for k, c in columns.items()])

    def listed(self, value: Column | None = None) -> DataFrame:
        columns = {"path": F.col("path")} | ({"value": value} if value is not None else {})
        return self.table(**columns)

    def tasks_by(self, key: str = "path") -> DataFrame:
        """Tasks nested by note, or by another key, whose tasks are a few."""
        fields = [c for c in self.df.columns if c != key]
        at = self.df.withColumn("__at", F.row_number().over(W.partitionBy(key).orderBy(*self.order)))
        nested = at.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__at", *fields))).alias("rows"))
        return nested.select(key, F.transform("rows", lambda r: r.dropFields("__at")).alias("rows"))

    def calendar(self, day: Column) -> DataFrame:
        """day, n and the first DAY_ITEMS paths of each day; rows without a date are left out."""
        dated = self.df.withColumn("day", F.to_date(day)).where("day is not null")
        # Counts and first items are taken apart: both shrink before they are shuffled, however full a day is.
        first = dated.withColumn("__at", F.row_number().over(W.partitionBy("day").orderBy(*self.order))).where(F.col("__at") <= DAY_ITEMS)
        items = first.groupBy("day").agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "path"))), lambda x: x["path"]).alias("items"))
        return dated.groupBy("day").agg(F.count("*").alias("n")).join(items, "day").orderBy("day")

    def capped(self, most: int = CAP) -> tuple[DataFrame, Callable[[], int]]:
        """The first rows, and the count of all."""
        return self.df.orderBy(*self.order).limit(most), self.df.count


# Where rows come from: set operations over notes --------------------------------------------------------------------


def in_folder(path: Column, folder: str) -> Column:
    """In the folder or below, or the note itself; case does not matter."""
    low, folder = F.lower(path), folder.lower().rstrip("/")
    return low.startswith(f"{folder}/") | low.isin(folder, f"{folder}.md")


def has_tag(tags: Column, tag: str) -> Column:
    """The tag or one below it, in an array of tags."""
    tag = tag.lower().lstrip("#")
    return F.coalesce(F.exists(tags, lambda t: (F.lower(t) == tag) | F.lower(t).startswith(f"{tag}/")), F.lit(False))


def tagged_notes(notes: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    """The same over a table of tags(note path, tag_lc)."""
    tag = tag.lower().lstrip("#")
    return notes.join(tags.where((F.col("tag_lc") == tag) | F.col("tag_lc").startswith(f"{tag}/")).select("path"), "path", "left_semi")


def linking_to(notes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    return notes.join(edges.where(F.col("dst") == path).select(F.col("src").alias("path")), "path", "left_semi")


def linked_from(notes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """With the place of the link, `link_ord`."""
    return notes.join(edges.where(F.col("src") == path).groupBy(F.col("dst").alias("path")).agg(F.min("ord").alias("link_ord")), "path")


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("path"), "path", "left_semi")


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """Those of a, then those of b alone."""
    return a.unionByName(b.join(a.select("path"), "path", "left_anti"))


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("path"), "path", "left_anti")


def followed(rows: DataFrame, link: Column, notes: DataFrame, **columns: str) -> DataFrame:
    """rows with columns of the notes that a link leads to, null where it leads nowhere."""
    other = notes.select(F.col("path").alias("__to"), *[F.col(c).alias(k) for k, c in columns.items()])
    return rows.join(other, link == F.col("__to"), "left").drop("__to")
