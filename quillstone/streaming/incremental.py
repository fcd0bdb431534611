"""Keeping tables up to date: listing diffs, change feeds, and a stream of changed notes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def listing_diff(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """path, op (new, edited, deleted) between two tables of path, mtime, size. Equal time and size mean unchanged."""
    a = catalog.select("path", F.struct("mtime", "size").alias("was"))
    b = listing.select("path", F.struct("mtime", "size").alias("now"))
    op = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("now")), "edited")
    return a.join(b, "path", "full").select("path", op.alias("op")).where("op is not null")


def under(changes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Changes of folders as changes of the notes in them: every folder above a note is joined by equality."""
    parents = catalog.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))).alias("at"))
    return parents.join(changes.withColumnRenamed("path", "at"), "at").select("path", "op").distinct()


def latest(feed: DataFrame, key: str, version: Column) -> DataFrame:
    """The last change of each key."""
    return feed.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(version.desc()))).where("__n = 1").drop("__n")


def applied(table: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """table after feed(op upsert or delete, columns of the table), one change a key: rows of changed keys go, new ones come."""
    return table.join(feed.select(key).distinct(), key, "left_anti").unionByName(feed.where("op = 'upsert'").select(*table.columns))


def touched_by_names(raw_links: DataFrame, changed_stems: DataFrame) -> DataFrame:
    """Notes of raw_links(path, raw) whose links may lead elsewhere after files of these stems came or went."""
    base = F.lower(F.regexp_extract("raw", r"([^/#|]*?)(?:\.md)?(?:[#|].*)?$", 1))
    return raw_links.withColumn("stem", base).join(changed_stems.select(F.lower("stem").alias("stem")).distinct(), "stem", "left_semi").select("path").distinct()


def follow(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str = "700 milliseconds"):
    """A streaming query that hands each batch of changes, one row a path, to apply(batch, id)."""

    def batch(df: DataFrame, number: int) -> None:
        apply(latest(df, "path", F.col("seq")), number)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def quiet_changes(changes: DataFrame, quiet: str = "700 milliseconds", late: str = "0 seconds") -> DataFrame:
    """path, op, first, last, n of changes(path, op, ts): the last change of each burst, a burst being changes of a path less than `quiet` apart.

    A table or a stream; on a stream, times are the events' own, and a burst comes out once others are `quiet` and `late`
    after its end. State is a session a path, which Spark merges and drops by itself.
    """
    if changes.isStreaming:
        changes = changes.withWatermark("ts", late)
    burst = changes.groupBy("path", F.session_window("ts", quiet).alias("burst"))
    out = burst.agg(F.max_by("op", "ts").alias("op"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return out.select("path", "op", F.col("burst.start").alias("first"), "last", "n")


def quiet_feed(changes: DataFrame, quiet_ms: int = 700) -> DataFrame:
    """path, op, n of a live stream of changes(path, op, ts): a path comes out when nothing has come for it for quiet_ms of the clock.

    Each path has a timer of its own, kept in the state store, so a restart or a lost executor neither loses nor repeats it,
    and the last change comes out though no other follows.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames, state: GroupState):
        if state.hasTimedOut:
            op, _, n = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "op": [op], "n": [n]})
            return
        op, ts, n = state.get if state.exists else (None, -1, 0)
        for f in frames:
            at = f["ts"].astype("int64").to_numpy()
            if len(f) and at.max() >= ts:
                op, ts = f["op"].iloc[int(at.argmax())], int(at.max())
            n += len(f)
        state.update((op, ts, n))
        state.setTimeoutDuration(quiet_ms)

    return changes.groupBy("path").applyInPandasWithState(step, "path string, op string, n long", "op string, ts long, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def spread(changes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Changes of notes, and deletions of folders as deletions of all that catalog(path) has below them."""
    gone = under(changes.where("op = 'deleted'").select("path", "op"), catalog)
    return changes.select("path", "op").unionByName(gone).distinct()


def windowed(events: DataFrame, length: str, late: str) -> DataFrame:
    """Counts and sums of a stream of events(ts, event_type, value) by tumbling windows, closed after the lateness."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
