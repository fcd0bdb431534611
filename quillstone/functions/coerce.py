"""How values of a view compare when their kinds differ, and what objects, links and sums of mixed values are.

A kind (null, boolean, number, string, date, duration in milliseconds, link as values.link() has it) is known when a view is
built, so each rule is a typed expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.values import equal, link_date, natural_key, shown

NUMERIC = ("boolean", "number", "date", "duration")


def as_day(s: Column) -> Column:
    """The time that a text stands for, null if it is none."""
    return F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.replace(s, F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm")))


def date_of(c: Column, kind: str) -> Column:
    """A date from a number (milliseconds), a text (as_day()), a link (the day in its display or path) or a date; null if there is none."""
    if kind == "number":
        return F.timestamp_millis(c.cast("long"))
    if kind == "link":
        return F.coalesce(link_date(c["display"]), link_date(c["path"]))
    return c.cast("timestamp") if kind == "date" else as_day(c)


def text_of(c: Column, kind: str) -> Column:
    return F.coalesce(c["display"], c["path"]) if kind == "link" else shown(c, kind)


def view_equal(a: Column, kind_a: str, b: Column, kind_b: str) -> Column:
    """Never null. A number equals its text, a date a text of that day, a link a text that names its note or its display."""
    if (kind_b, kind_a) in (("number", "string"), ("date", "string"), ("link", "string")):
        return view_equal(b, kind_b, a, kind_a)
    some = a.isNotNull() & b.isNotNull()
    if kind_a == kind_b:
        return equal(F.lower(a["path"]), F.lower(b["path"])) if kind_a == "link" else equal(a, b)
    if kind_b == "string":
        match kind_a:
            case "number":
                own = a == F.trim(b).try_cast("double")
            case "date":
                own = a == as_day(b)
            case "link":
                bare = lambda c: F.regexp_replace(F.lower(c), r"\.md$", "")
                own = (bare(a["path"]) == bare(b)) | (F.lower(F.coalesce(a["display"], F.lit(""))) == F.lower(b))
            case _:
                own = F.lit(False)
        return F.when(some, F.coalesce(own, F.lit(False))).otherwise(a.isNull() & b.isNull())
    return a.isNull() & b.isNull()


def view_compare(a: Column, kind_a: str, b: Column, kind_b: str) -> Column:
    """-1, 0 or 1; null comes last. Numbers, booleans, dates and durations compare as numbers, anything else as text, digits by number."""
    number = lambda c, kind: F.unix_millis(c.cast("timestamp")).cast("double") if kind == "date" else c.cast("double" if kind != "boolean" else "int").cast("double")
    sign = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
    as_text = sign(natural_key(text_of(a, kind_a)), natural_key(text_of(b, kind_b)))
    if kind_a in NUMERIC and kind_b in NUMERIC:
        own = sign(number(a, kind_a), number(b, kind_b))
    elif (kind_a, kind_b) == ("date", "string"):
        own = F.when(as_day(b).isNotNull(), sign(a, as_day(b))).otherwise(as_text)
    elif (kind_a, kind_b) == ("string", "date"):
        own = F.when(as_day(a).isNotNull(), sign(as_day(a), b)).otherwise(as_text)
    else:
        own = as_text
    return F.when(a.isNull() | b.isNull(), a.isNull().cast("int") - b.isNull().cast("int")).otherwise(own)


def view_less(a: Column, kind_a: str, b: Column, kind_b: str, or_equal: bool = False) -> Column:
    """False when a side is null."""
    order = view_compare(a, kind_a, b, kind_b)
    return a.isNotNull() & b.isNotNull() & ((order <= 0) if or_equal else (order < 0))


def mixed_sum(values: list[Column], kinds: list[str]) -> Column:
    """Nulls are left out, null if none is left; numbers add up until a text comes, from which on all is text."""
    if "string" not in kinds:
        some = reduce(lambda x, y: x | y, [v.isNotNull() for v in values])
        return F.when(some, reduce(lambda x, y: x + y, [F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])).cast("string")
    state = F.struct(F.lit(None).cast("double").alias("n"), F.lit(None).cast("string").alias("s"))
    for v, kind in zip(values, kinds, strict=True):
        number = v.cast("double") if kind == "number" else F.lit(None).cast("double")
        sofar = F.coalesce(state["s"], F.when(state["n"].isNotNull(), shown(state["n"], "number")))
        added = F.struct(F.when(state["s"].isNull(), F.coalesce(state["n"] + number, number)).alias("n"), F.when(state["s"].isNotNull(), F.concat(state["s"], shown(v, kind))).alias("s")) if kind == "number" else F.struct(F.lit(None).cast("double").alias("n"), F.concat(F.coalesce(sofar, F.lit("")), v.cast("string")).alias("s"))
        state = F.when(v.isNull(), state).otherwise(added)
    return F.coalesce(state["s"], F.when(state["n"].isNotNull(), shown(state["n"], "number")))


def object_keys(fields: Column) -> Column:
    return F.map_keys(fields)


def object_values(fields: Column) -> Column:
    return F.map_values(fields)


def links_to(rows: DataFrame, link: Column, edges: DataFrame, target: str, name: str) -> DataFrame:
    """rows with a boolean: whether the note that a link leads to has a link to the target. One semi-join side of the target's sources."""
    sources = edges.where(F.lower("dst") == target.lower()).select(F.lower("src").alias("__src")).distinct().withColumn("__yes", F.lit(True))
    return rows.join(sources, F.lower(link["path"]) == F.col("__src"), "left").withColumn(name, F.coalesce("__yes", F.lit(False))).drop("__src", "__yes")
