"""Mixing sources to target weights with a time-varying curriculum.

* Targets. Sources share a multiple of all words by weight; one that would go over its limit of repeats stops there, and
  the rest is shared again. Each round is one aggregate over the table of sources; only sums go to the driver.
* Takes. A source's documents stand in the order of a digest; their words are laid end to end, round after round, until
  the target is met, the last document in part. Offsets come from sums of (source, slice of the digests), so that a
  source of a third of all rows is summed in as many tasks as its slices need.
* Positions. A source's weight over the training time from 0 to 1 is a line through knots. Its integral, scaled to the
  target, is the demand for the source's words so far; the time at which it reaches a document's offset is the
  document's position. Documents are range-sorted by their first position, training rows (occurrences) by their own.

Defined results: a null text has size 0 and is never taken; null is a source of its own, apart from the empty name, and
the last; a source without words has target 0; rows that agree in doc_id and text take each other's place freely; null
doc_ids stay; an empty table gives no rows; columns asked for pass through, and own names that they take get an
underscore in front.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, free_names, read


@dataclass(frozen=True)
class Kind:
    """A weight, and the knots (time, relative weight) of its course over the training."""

    weight: int
    knots: tuple[tuple[float, float], ...] = ((0.0, 1.0), (1.0, 1.0))


#: Sources in the order of their names have these kinds in turn: one that fades, one that stays, one that comes late.
KINDS = (Kind(3, ((0.0, 1.5), (1.0, 0.5))), Kind(1), Kind(2, ((0.0, 0.25), (0.5, 0.75), (1.0, 2.25))))
#: All words that the mix takes, as a share of all there are, and how often a source may be repeated.
SHARE_PERCENT, REPEATS = 150, 2
#: Slices of each source's digests, at least, and rows of all documents a slice.
SLICES, SLICE_ROWS = 256, 20_000

OWN = ("size", "source_size", "target", "taken", "position", "positions")


def words_in(text: Column) -> Column:
    """Runs of other characters than space and U+0009 to U+000D."""
    marked = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def segments(knots: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float, float]]:
    """start, demand before, demand to the end, weight at the start, slope of each piece, with all demand as 1."""
    pieces = list(zip(knots, knots[1:], strict=False))
    whole = sum((t - s) * (v + w) / 2 for (s, v), (t, w) in pieces)
    out, before = [], 0.0
    for (s, v), (t, w) in pieces:
        after = before + (t - s) * (v + w) / 2 / whole
        out.append((s, before, after, v / whole, (w - v) / (t - s) / whole))
        before = after
    return out


def inverse_sql(y: str, kind: Kind) -> str:
    """The time at which a share y of the demand has come, as SQL: the root of weight * x + slope / 2 * x ^ 2 = y - before."""
    number = lambda x: f"{x!r}e0" if "e" not in repr(x) else repr(x)  # noqa: E731  doubles in every dialect
    each = []
    for s, before, _, v, slope in segments(kind.knots):
        rest = f"greatest({y} - {number(before)}, 0e0)"
        each.append(f"{number(s)} + coalesce(2e0 * {rest} / nullif({number(v)} + sqrt(greatest({number(v * v)} + {number(2 * slope)} * {rest}, 0e0)), 0e0), 0e0)")
    ends = [after for _, _, after, _, _ in segments(kind.knots)][:-1]
    return "CASE " + " ".join(f"WHEN {y} < {number(a)} THEN {x}" for a, x in zip(ends, each, strict=False)) + f" ELSE {each[-1]} END" if ends else each[-1]


def numbered(rows: DataFrame, order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """Rows with their place in that order: range partitions, each counted; the driver holds one count a partition."""
    rows = scratch.table(rows, f"{name}-rows")  # the range partitioner reads it twice
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = scratch.table(placed, name)
    counts, before, offsets = placed.groupBy(F.shiftright("at", 33).alias("part")).count().orderBy("part").collect(), 0, []
    for r in counts:
        offsets.append((r.part, before))
        before += r["count"]
    offsets = rows.sparkSession.createDataFrame(offsets, "part long, before long")
    within = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), F.shiftright("at", 33) == F.col("part")).withColumn("rank", F.col("before") + within).drop("at", "part", "before")


def targets(sources: DataFrame, kinds: tuple[Kind, ...], share_percent: int, repeats: int, scratch: Scratch) -> DataFrame:
    """name, source_size, kind, target of sources(name, source_size)."""
    weight = F.element_at(F.array(*[F.lit(k.weight) for k in kinds]), (F.col("kind") + 1).cast("int"))
    ranked = numbered(sources, ["name"], "sources", scratch).withColumn("kind", F.pmod("rank", F.lit(len(kinds))))
    ranked = scratch.table(ranked.select("name", "source_size", "kind", weight.alias("weight"), (repeats * F.col("source_size")).alias("most")), "ranked")
    wanted = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share_percent / 100
    a_weight, held = 0.0, -1
    while True:
        over = F.col("most") <= a_weight * F.col("weight")
        found = ranked.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("most"))).alias("most"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if found.n == held or not found.weight:
            break
        held, a_weight = found.n, max(a_weight, (wanted - (found.most or 0)) / found.weight)  # rounding must not set a source free again
    target = F.when(over, F.col("most").cast("double")).otherwise(a_weight * F.col("weight"))
    return ranked.select("name", "source_size", "kind", target.alias("target"))


def mixed(docs: DataFrame, columns: list[str], kinds: tuple[Kind, ...] = KINDS, share_percent: int = SHARE_PERCENT, repeats: int = REPEATS) -> DataFrame:
    """The columns asked for, then all of OWN, for each of docs(doc_id, text, source), range-sorted by position.

    position and positions are times from 0 to 1: of the first word taken, and of each round that takes some of the text.
    """
    scratch = Scratch(docs.sparkSession, "source-mix")
    own = free_names(docs.select(*columns), *OWN)
    name = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source")))
    place = F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    kept = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    rows = scratch.table(docs.select(*kept, name.alias("name"), words_in(F.col("text")).alias("size"), place.alias("place")), "rows")
    slices = max(SLICES, rows.count() // SLICE_ROWS)
    rows = rows.withColumn("slice", F.expr(f"cast(floor(cast(conv(substring(place, 1, 10), 16, 10) as bigint) / {1 << 40}D * {slices}) as bigint)"))
    sums = scratch.table(rows.groupBy("name", "slice").agg(F.sum("size").alias("words")), "sums")
    plan = scratch.table(targets(sums.groupBy("name").agg(F.sum("words").alias("source_size")), kinds, share_percent, repeats, scratch), "targets")
    upto = Window.partitionBy("name").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.table(sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).drop("words").join(plan, "name"), "offsets")
    upto = Window.partitionBy("name", "slice").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(upto), F.lit(0))).join(offsets, ["name", "slice"])
    start, demand = F.col("before") + F.col("within"), F.floor(F.col("target") + 0.5)
    taken = lambda e: F.greatest(F.lit(0), F.least(F.col("size"), F.col("demand") - F.col("start") - e * F.col("source_size")))
    rows = rows.withColumns({"start": start, "demand": demand})
    rounds = F.filter(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda e: taken(e) > 0)
    shares = F.transform(rounds, lambda e: (e * F.col("source_size") + F.col("start")).cast("double") / F.col("demand").cast("double"))
    times = F.when(F.lit(False), F.array().cast("array<double>"))
    for i, kind in enumerate(kinds):
        times = times.when(F.col("kind") == i, F.expr(f"transform(shares, y -> {inverse_sql('y', kind)})"))
    all_taken = F.aggregate(F.sequence(F.lit(0), F.lit(repeats - 1)), F.lit(0).cast("long"), lambda a, e: a + taken(e))
    rows = rows.withColumns({"shares": shares, "taken": all_taken}).withColumn("positions", times).withColumn("position", F.get("positions", F.lit(0)))
    kept = [f"c{i}" for i in range(len(columns))]
    placed = scratch.table(rows.select(*kept, *OWN, "place"), "placed")  # the range partitioner reads it twice
    scratch.keep("placed")
    by = [F.col("position").asc_nulls_last(), F.col("place")]
    return placed.repartitionByRange(*by).sortWithinPartitions(*by).drop("place").toDF(*columns, *own)


def training_rows(mix: DataFrame) -> DataFrame:
    """A row for each round that takes some of a document of mixed(), in the order of the training, with time and round."""
    rows = mix.select("*", F.posexplode("positions").alias("round", "time"))
    return rows.repartitionByRange("time").sortWithinPartitions("time")


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), ["doc_id"]).drop("positions")


OP12_SQL = f"""
WITH docs AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS name,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
        md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, ''))) AS place FROM documents),
    sizes AS (SELECT name, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY name) - 1) % {len(KINDS)} AS kind FROM docs GROUP BY name),
    weighed AS (SELECT *, [{", ".join(str(k.weight) for k in KINDS)}][kind + 1] AS weight, {REPEATS} * source_size AS most,
        sum(source_size) OVER () * {SHARE_PERCENT} / 100 AS wanted FROM sizes),
    levels AS (SELECT *, (wanted - coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed WINDOW w AS (ORDER BY most / weight, name)),
    plan AS (SELECT name, source_size, kind, CAST(least(most, weight * a_weight) AS DOUBLE) AS target
        FROM levels, (SELECT arg_min(level, (most / weight, name)) AS a_weight FROM levels WHERE level * weight < most) ),
    laid AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY name ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
        floor(target + 0.5) AS demand FROM docs JOIN plan USING (name)),
    rounds AS (SELECT *, greatest(0, least(size, demand - start)) AS once, greatest(0, least(size, demand - start - source_size)) AS again,
        CAST(start AS DOUBLE) / CAST(demand AS DOUBLE) AS y FROM laid)
SELECT doc_id, size, source_size, target, CAST(once + again AS BIGINT) AS taken,
    CASE WHEN once = 0 THEN NULL {" ".join(f"WHEN kind = {i} THEN {inverse_sql('y', k)}" for i, k in enumerate(KINDS))} END AS position
FROM rounds
"""
