"""Counts and short lists of a vault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.values import DAY_MS, plus_ms

FOLDERS_SHOWN, TAGS_SHOWN = 12, 30


def stats(notes: DataFrame, now: Column, edges: DataFrame | None = None) -> DataFrame:
    """notes, edited today, edited in the last seven days (today included); with edges also links, and tags: how many different ones there are."""
    day = F.date_trunc("day", now)
    counts = notes.agg(F.count("*").alias("notes"), F.count_if(F.col("mtime") >= day).alias("today"), F.count_if(F.col("mtime") >= plus_ms(day, -6 * DAY_MS)).alias("week"))
    if edges is None:
        return counts
    # Three rows, one for each table that is counted, folded into one.
    none = F.lit(None).cast("long")
    rows = counts.withColumns({"links": none, "tags": none})
    rows = rows.unionByName(edges.agg(F.count("*").alias("links")), allowMissingColumns=True).unionByName(tag_counts(notes).agg(F.count("*").alias("tags")), allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in ("notes", "today", "week", "links", "tags")])


def recent(notes: DataFrame, n: int) -> DataFrame:
    return notes.orderBy(F.col("mtime").desc(), "path").limit(n)


def top_folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("")


def folders(notes: DataFrame, most: int = FOLDERS_SHOWN) -> DataFrame:
    """Top folders with the most notes."""
    return notes.groupBy(top_folder(F.col("path")).alias("folder")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "folder").limit(most)


def listed_folders(notes: DataFrame, prefixes: list[str]) -> DataFrame:
    """Notes under each prefix that is asked for; one pass, however many."""
    counts = notes.agg(*[F.count_if(F.lower("path").startswith(p.lower())).alias(f"n{i}") for i, p in enumerate(prefixes)])
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("prefix"), F.col(f"n{i}").alias("n")) for i, p in enumerate(prefixes)]))
    return counts.select(pairs.alias("p")).select("p.prefix", "p.n")


def tag_counts(notes: DataFrame) -> DataFrame:
    return notes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def top_tags(notes: DataFrame, n: int) -> DataFrame:
    return tag_counts(notes).orderBy(F.desc("n"), "tag").limit(n)


def vault_info(notes: DataFrame) -> DataFrame:
    """what, name, n: the number of notes, folders by size and the most used tags."""
    row = lambda what, name: (F.lit(what).alias("what"), name.alias("name"), F.col("n"))
    total = notes.agg(F.count("*").alias("n")).select(*row("notes", F.lit("")))
    by_folder = folders(notes, 1_000_000).select(*row("folder", F.col("folder")))
    return total.unionByName(by_folder).unionByName(top_tags(notes, TAGS_SHOWN).select(*row("tag", F.col("tag"))))


def month_grid(days: DataFrame, month: str) -> DataFrame:
    """The weeks of a month from Monday: day, weekday (1 is Monday), week, in_month, n, from days(day, n)."""
    first = F.lit(f"{month}-01").cast("date")
    begin, end = F.date_trunc("week", first).cast("date"), F.date_add(F.date_trunc("week", F.last_day(first)).cast("date"), 6)
    grid = days.sparkSession.range(1).select(F.explode(F.sequence(begin, end)).alias("day"))
    week = F.floor(F.datediff("day", begin) / 7).cast("int")
    shown = grid.select("day", (F.weekday("day") + 1).alias("weekday"), week.alias("week"), (F.date_format("day", "yyyy-MM") == month).alias("in_month"))
    return shown.join(days.select("day", "n"), "day", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
