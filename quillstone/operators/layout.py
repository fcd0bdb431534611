"""Where the notes of a graph are drawn: pivot scaling, radial equalising, smoothing, fanning out, collisions, packing.

positions are rows of component, path, x, y; each step works on all components at once and on no component as a whole, by
joins along links, sums by component and ranks from range partitions. What a round writes goes when the next one stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.graph import both_ways, ranked
from quillstone.operators.ranks import prefix_sums
from quillstone.sources.scratch import removed, widened, written

#: Pivots, and how many are chosen together: far from all so far, spread over the nearest ones of those.
PIVOTS, BATCHES = 40, (1, 3, 12, 24)
#: Links between notes are drawn about so long, notes are kept one unit apart; notes of a cell that others meet.
SPRING = 1.5
#: Notes of a cell that others meet at once, about.
PART = 4_000
SMOOTH_ROUNDS, COLLISION_ROUNDS = 30, 24
GOLDEN = float(np.pi * (3 - np.sqrt(5)))


def searched(links: DataFrame, starts: list[str], hops: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """path, bits, hop: which of up to 63 starts are so many links away from a note, a row for each hop that any is at; and the tables to remove after use.

    One search for all: a bit for each start travels along the links, and a note takes part in a round with the bits that are
    new to it. A hub's links are combined within tasks, and a search ends when no bit is new anywhere.
    """
    spark = links.sparkSession
    start = {}
    for i, p in enumerate(starts):
        start[p] = start.get(p, 0) | 1 << i
    front = spark.createDataFrame(list(start.items()), "path string, bits long").withColumn("hop", F.lit(0))
    seen, found, k = front.select("path", "bits"), [front], 0
    while hops is None or k < hops:
        k += 1
        met = front.join(links, front["path"] == links["src"]).groupBy(F.col("dst").alias("path")).agg(F.bit_or("bits").alias("bits"))
        met = met.join(seen.withColumnRenamed("bits", "had"), "path", "left").withColumn("had", F.coalesce("had", F.lit(0).cast("long")))
        front = written(met.select("path", F.col("bits").bitwiseAND(F.bitwise_not(F.col("had"))).alias("bits"), F.lit(k).alias("hop")).where("bits <> 0"), f"hop{k}")
        if front.isEmpty():
            removed(front)
            break
        found.append(front)
        both = seen.unionByName(front.select("path", "bits")).groupBy("path").agg(F.bit_or("bits").alias("bits"))
        new = written(both, f"seen{k}")
        if k > 1:
            removed(seen)
        seen = new
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    return rows, [*found[1:], *([seen] if len(found) > 1 else [])]


def pivot_distances(links: DataFrame, pivots: list[str], hops: int | None = None) -> DataFrame:
    """path, pivot (its number), hop: how many links away each note is from each of up to 63 pivots, for what can be reached; links(src, dst) go both ways."""
    rows, used = searched(links, pivots, hops)
    # Only the bits that are set become rows.
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(1 << i).cast("long").alias("bit")) for i in range(len(pivots))])
    bits = F.transform(F.filter(each, lambda s: F.col("bits").bitwiseAND(s["bit"]) != 0), lambda s: s["i"])
    out = written(rows.select("path", F.explode(bits).alias("pivot"), "hop"), "distances")
    removed(*used)
    return out


@dataclass
class Distances:
    """How far all notes with a link are from the pivots, without a row for each of them.

    A leaf, a note whose only neighbour is in the core, is one link farther than that neighbour from all but itself. So only
    the core takes part in searches: core has path, leaves (how many), least (the first leaf by path that is no pivot) and d, the
    distances in the order of the pivots, null where one isn't reached; leaves has path and of, the neighbour.
    """

    core: DataFrame
    leaves: DataFrame
    hops: int | None
    pivots: list[str]
    #: Pivots that are leaves, and their neighbours.
    outer: dict[str, str]

    def further(self, own: Column | None = None) -> Column:
        """Distances of a leaf from those of its neighbour; 0 from the pivot of its own number, if it is one."""
        near = lambda x: x + 1 if self.hops is None else F.when(x + 1 <= self.hops, x + 1)
        return F.transform("d", near) if own is None else F.transform("d", lambda x, i: F.when(i == own, F.lit(0.0)).otherwise(near(x)))

    def outer_pivots(self) -> DataFrame:
        """path, of, own of the pivots that are leaves."""
        rows = [(p, of, self.pivots.index(p)) for p, of in self.outer.items()]
        return F.broadcast(self.core.sparkSession.createDataFrame(rows, "path string, of string, own int"))

    def every(self) -> DataFrame:
        """path, d of all notes."""
        leaves = self.leaves.join(self.core.select(F.col("path").alias("of"), "d"), "of").join(self.outer_pivots().drop("of"), "path", "left")
        return self.core.select("path", "d").unionByName(leaves.select("path", self.further(F.col("own")).alias("d")))

    def alike(self) -> DataFrame:
        """path, d: all of the core, and of leaves with the same neighbour, which are alike, the first that is no pivot."""
        return self.core.select("path", "d").unionByName(self.core.where("least is not null").select(F.col("least").alias("path"), self.further().alias("d")))

    def weighted(self) -> DataFrame:
        """n, d: all notes, those of the same neighbour counted."""
        few = self.outer_pivots()
        taken = F.broadcast(few.groupBy(F.col("of").alias("path")).agg(F.count("*").alias("taken")))
        rest = self.core.where("leaves > 0").join(taken, "path", "left").withColumn("n", F.col("leaves") - F.coalesce("taken", F.lit(0))).where("n > 0")
        own = few.join(self.core.select(F.col("path").alias("of"), "d"), "of").select(F.lit(1).cast("long").alias("n"), self.further(F.col("own")).alias("d"))
        return self.core.select(F.lit(1).cast("long").alias("n"), "d").unionByName(rest.select("n", self.further().alias("d"))).unionByName(own)

    def extended(self, links: DataFrame, batch: list[str]) -> Distances:
        """With a batch of pivots more; what this one has written for its core goes."""
        spark = links.sparkSession
        outer = {r["path"]: r["of"] for r in self.leaves.where(F.col("path").isin(batch)).collect()}
        rows, used = searched(links, [outer.get(p, p) for p in batch], self.hops)
        at = lambda i, p: F.col("hop") + (1.0 if p in outer else 0.0)
        each = [F.max(F.when(F.col("bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0, at(i, p))).alias(f"d{i}") for i, p in enumerate(batch)]
        new = F.array(*[F.col(f"d{i}") if self.hops is None else F.when(F.col(f"d{i}") <= self.hops, F.col(f"d{i}")) for i in range(len(batch))])
        core = self.core.join(rows.groupBy("path").agg(*each), "path", "left").withColumn("d", F.concat("d", new)).select(self.core.columns)
        pivots, outer = self.pivots + batch, self.outer | outer
        if outer:
            # What comes first after those that are pivots now.
            of = sorted(set(outer.values()))
            after = {r["of"]: r["least"] for r in self.leaves.where(F.col("of").isin(of) & ~F.col("path").isin(list(outer))).groupBy("of").agg(F.min("path").alias("least")).collect()}
            after = F.broadcast(spark.createDataFrame([(k, after.get(k), True) for k in of], "path string, after string, __hit boolean"))
            core = core.join(after, "path", "left").withColumn("least", F.when(F.col("__hit"), F.col("after")).otherwise(F.col("least"))).select(self.core.columns)
        core = written(core, "core")
        removed(self.core, *used)
        return Distances(core, self.leaves, self.hops, pivots, outer)


def core_and_leaves(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, str | None]:
    """The core with the number of each note's leaves and the first of them, the leaves, the links(src, dst) within the core, both ways, and the best-linked note.

    Of two notes that have no other neighbour than each other, the first is the core.
    """
    ends = F.explode(F.array(F.struct(F.col("src").alias("path"), F.col("dst").alias("to")), F.struct(F.col("dst").alias("path"), F.col("src").alias("to")))).alias("e")
    to = F.when(F.col("e.to") != F.col("e.path"), F.col("e.to"))
    nodes = written(edges.select(ends).groupBy(F.col("e.path").alias("path")).agg(F.count("*").alias("degree"), F.min(to).alias("low"), F.max(to).alias("high")), "nodes")
    best = nodes.orderBy(F.desc("degree"), "path").first()
    one = nodes.where("low = high").select("path", F.col("low").alias("of"))
    back = one.where("of < path").select(F.col("of").alias("path"), F.col("path").alias("of"))
    pairs = written(one.where("path < of").join(back, ["path", "of"], "left_semi"), "pairs")
    leaves = written(one.join(pairs.select("path"), "path", "left_anti"), "leaves")
    inner = nodes.where("low is null or low <> high").select("path").unionByName(pairs.select("path"))
    counted = leaves.groupBy(F.col("of").alias("path")).agg(F.count("*").alias("leaves"), F.min("path").alias("least"))
    core = written(inner.join(counted, "path", "left").select("path", F.coalesce("leaves", F.lit(0).cast("long")).alias("leaves"), "least", F.array().cast("array<double>").alias("d")), "core")
    within = edges.select("src", "dst").where("src <> dst")
    for end in ("src", "dst"):
        within = within.join(core.select(F.col("path").alias(end)), end, "left_semi").select("src", "dst")
    links = written(both_ways(within).distinct(), "links")
    removed(nodes, pairs)
    return core, leaves, links, best["path"] if best else None


def pivoted(edges: DataFrame, pivots: int = PIVOTS, hops: int | None = None, batches: tuple[int, ...] = BATCHES) -> Distances:
    """Distances from the pivots: the best-linked note, then batches of those farthest from all pivots so far."""
    core, leaves, links, best = core_and_leaves(edges)
    found = Distances(core, leaves, hops, [], {})
    batch = [best] if best is not None else []
    sizes = iter((*batches[1:], *[batches[-1]] * pivots))
    while batch:
        found = found.extended(links, batch)
        chosen = found.pivots
        if len(chosen) >= pivots:
            break

        def near(rows: DataFrame) -> DataFrame:
            each = rows.withColumn("alike", F.transform("d", lambda x: F.coalesce(x, F.lit(float("inf")))))
            least = F.array_min(F.transform("alike", lambda x, i: F.struct(x.alias("d"), i.alias("i"))))
            return each.withColumn("near", least).select("path", F.col("near.d").alias("least"), F.col("near.i").alias("of"), "alike").where("least > 0")

        # Notes at equal distances from all pivots are alike, such as those of a component without one: the first stands for them.
        size = min(next(sizes), pivots - len(chosen))
        alike = written(near(found.alike()).groupBy("of", "least", "alike").agg(F.min("path").alias("path")), "alike")
        # The farthest of each pivot's surroundings first: a batch that is spread like the pivots are.
        each = alike.groupBy("of").agg(F.min_by("path", F.struct(-F.col("least"), F.col("path"))).alias("path"), F.max("least").alias("least")).orderBy(F.desc("least"), "path").limit(size).collect()
        batch = [r["path"] for r in each]
        if len(batch) < size:
            batch += [r["path"] for r in alike.where(~F.col("path").isin(batch)).orderBy(F.desc("least"), "path").limit(size - len(batch)).collect()]
        if len(batch) < size:
            batch += [r["path"] for r in near(found.every()).where(~F.col("path").isin(batch)).orderBy(F.desc("least"), "path").limit(size - len(batch)).collect()]
        removed(alike)
    removed(links)
    return found


def pivot_table(edges: DataFrame, pivots: int = PIVOTS, hops: int | None = None, batches: tuple[int, ...] = BATCHES) -> tuple[DataFrame, list[str]]:
    """path, d0, d1, ... of every note with a link, and the pivots: the best-linked note, then batches of those farthest from all pivots so far."""
    found = pivoted(edges, pivots, hops, batches)
    return found.every().select("path", *[F.col("d")[k].alias(f"d{k}") for k in range(len(found.pivots))]), found.pivots


def pivot_layout(edges: DataFrame, pivots: int = PIVOTS, hops: int | None = None) -> DataFrame:
    """path, x, y: pivot multidimensional scaling. Only a pivots x pivots matrix, summed up within tasks, is solved on the driver.

    A search goes on until no note is new, unless hops bound it. What it does not reach counts as one link beyond the greatest distance from any pivot.
    Leaves with the same neighbour have the same place, which is worked out once.
    """
    places = pivoted(edges, pivots, hops)
    n = len(places.pivots)
    if not n:
        return places.core.select("path", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    table = places.weighted()
    beyond = float(hops) if hops is not None else table.agg(F.max(F.array_max("d"))).first()[0]
    squares = lambda d: F.transform(d, lambda x: F.coalesce(x, F.lit(beyond + 1)) ** 2)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts, sums and products of the squares that a task reads."""
        count, total, product, side = 0, np.zeros(n), np.zeros((n, n)), np.zeros(n)
        for b in batches:
            w = b.column("n").to_numpy()[:, None].astype(float)
            s = b.column("s").flatten().to_numpy().reshape(-1, n)
            u = s - s.mean(axis=1, keepdims=True)
            count, total, product, side = count + w.sum(), total + (w * s).sum(axis=0), product + (w * u).T @ u, side + (w * u).sum(axis=0)
        gathered = np.concatenate([[count], total, product.reshape(-1), side])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(gathered))), pa.array(gathered)], ["i", "v"])

    found = {r["i"]: r["v"] for r in table.select("n", squares("d").alias("s")).mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    flat = np.array([found[i] for i in range(len(found))])
    count, total, product, side = flat[0], flat[1 : n + 1], flat[n + 1 : n + 1 + n * n].reshape(n, n), flat[n + 1 + n * n :]
    # Centred c = -1/2 (s - row mean - column mean + grand mean); the Gram matrix from sums of u = s - row mean.
    shift = total / count - total.mean() / count
    gram = (product - np.outer(side, shift) - np.outer(shift, side) + count * np.outer(shift, shift)) / 4
    vectors = np.linalg.eigh(gram)[1][:, ::-1]

    def placed(rows: DataFrame, d: Column, *names: str) -> DataFrame:
        """rows with their places on the two axes."""
        rows = rows.withColumn("__s", squares(d)).withColumn("__m", F.aggregate("__s", F.lit(0.0), lambda a, x: a + x) / n)
        centred = lambda k: -0.5 * (F.col("__s")[k] - F.col("__m") - F.lit(float(shift[k])))
        axis = lambda v: sum((centred(k) * float(v[k]) for k in range(1, n)), centred(0) * float(v[0]))
        return rows.withColumns({name: axis(vectors[:, min(k, n - 1)]) for k, name in enumerate(names)}).drop("__s", "__m")

    core = placed(placed(places.core, F.col("d"), "x", "y"), places.further(), "lx", "ly")
    core = written(core.select("path", "x", "y", "lx", "ly", "leaves"), "places")
    of = places.core.select(F.col("path").alias("of"), "d")
    own = written(placed(places.outer_pivots().join(of, "of"), places.further(F.col("own")), "ox", "oy").select("path", "ox", "oy"), "own")
    removed(places.core)
    around = core.where("leaves > 0").select(F.col("path").alias("of"), "lx", "ly")
    leaves = places.leaves.join(around, "of").join(F.broadcast(own), "path", "left")
    return core.select("path", "x", "y").unionByName(leaves.select("path", F.coalesce("ox", "lx").alias("x"), F.coalesce("oy", "ly").alias("y")))


def equalised(positions: DataFrame) -> DataFrame:
    """Notes at the same direction from their component's middle, at radii by their rank, so that they fill a disc of about 1.2 square units a note."""
    middle = positions.groupBy("component").agg(F.avg("x").alias("__cx"), F.avg("y").alias("__cy"), F.count("*").alias("__n"))
    around = positions.join(middle, "component").select("component", "path", "__n", (F.col("x") - F.col("__cx")).alias("x"), (F.col("y") - F.col("__cy")).alias("y")).withColumn("__r", F.hypot("x", "y"))
    radius = float(np.sqrt(1 / np.pi) * 1.25) * F.sqrt(F.col("__n") * 1.0) * F.sqrt((F.col("k") + 0.5) / F.col("__n"))
    scale = F.when(F.col("__r") > 0, radius / F.col("__r")).otherwise(0.0)
    return ranked(around, "component", F.col("__r"), F.col("path")).select("component", "path", (F.col("x") * scale).alias("x"), (F.col("y") * scale).alias("y"))


def smoothed(positions: DataFrame, edges: DataFrame, rounds: int = SMOOTH_ROUNDS) -> DataFrame:
    """Each note half way to the mean of those that it has links with, then equalised, so many times; equalised before the first."""
    links = both_ways(edges)
    out = written(equalised(positions), "equalised")
    for k in range(rounds):
        near = links.join(out.select(F.col("path").alias("dst"), "x", "y"), "dst").groupBy(F.col("src").alias("path")).agg(F.avg("x").alias("nx"), F.avg("y").alias("ny"))
        half = lambda c: ((F.col(c) + F.coalesce(f"n{c}", c)) / 2).alias(c)
        new = written(equalised(out.join(near, "path", "left").select("component", "path", half("x"), half("y"))), f"smooth{k}")
        removed(out)
        out = new
    return out


def fanned_out(positions: DataFrame) -> DataFrame:
    """Notes that share a cell of one unit on a sunflower around their middle, by their path."""
    cell = F.concat_ws(" ", F.col("component"), F.floor("x").cast("string"), F.floor("y").cast("string"))
    celled = positions.withColumn("__cell", cell)
    middle = celled.groupBy(F.col("__cell").alias("__of")).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n"))
    placed = ranked(celled, "__cell", F.col("path")).join(middle, F.col("__cell") == F.col("__of"))
    radius, angle = 0.55 * F.sqrt(F.col("k") + 0.5), F.col("k") * GOLDEN
    at = lambda c, m, f: F.when(F.col("n") < 2, F.col(c)).otherwise(F.col(m) + f(angle) * radius).alias(c)
    return placed.select("component", "path", at("x", "mx", F.cos), at("y", "my", F.sin))


def pushes(positions: DataFrame, same: bool = True) -> DataFrame:
    """path, px, py: how notes nearer than one unit push each other apart; those in one place only if same is set, in a direction by their names.

    A note meets all of those of its own cell and the eight around it, so the work grows with the pairs of near notes. A cell of
    more than PART notes is dealt out in parts, and a note meets each part by itself: no task has all pairs of a cell, or holds
    more of it than a part.
    """
    cell = lambda c: F.floor(F.col(c)).cast("long")
    # A small file is one task and would be broadcast, whatever the number of pairs in it.
    rows = widened(positions, "path").withColumns({"cx": cell("x"), "cy": cell("y")})
    # A row for each PART notes at most.
    dense = F.broadcast(rows.groupBy("component", "cx", "cy").agg(F.count("*").alias("n")).where(F.col("n") > PART).select("component", "cx", "cy", F.ceil(F.col("n") / PART).alias("parts")))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    others = rows.join(dense, ["component", "cx", "cy"], "left")
    others = others.select("component", "cx", "cy", F.pmod(F.xxhash64("path"), parts).alias("part"), F.col("path").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    steps = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    halo = rows.withColumn("s", F.explode(F.array(*steps))).withColumns({"cx": F.col("cx") + F.col("s.i"), "cy": F.col("cy") + F.col("s.j")}).drop("s")
    halo = halo.join(dense, ["component", "cx", "cy"], "left").select("component", "path", "x", "y", "cx", "cy", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    met = halo.join(others.hint("merge"), ["component", "cx", "cy", "part"]).where("path <> other and abs(x - ox) < 1 and abs(y - oy) < 1")
    met = met.select("path", "other", (F.col("x") - F.col("ox")).alias("dx"), (F.col("y") - F.col("oy")).alias("dy"))
    length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    together = length < 3e-5
    if same:
        turn = F.pmod(F.xxhash64(F.least("path", "other"), F.greatest("path", "other")), F.lit(3600)) * float(np.pi / 1800)
        sign = F.when(F.col("path") < F.col("other"), 1.0).otherwise(-1.0)
        met = met.withColumns({"dx": F.when(together, F.cos(turn) * sign * 0.1).otherwise(F.col("dx")), "dy": F.when(together, F.sin(turn) * sign * 0.1).otherwise(F.col("dy"))})
    else:
        met = met.where(~together)
    met = met.withColumn("d", length).where("d < 1").withColumn("f", (1 - F.col("d")) / F.col("d") * 0.25)
    return met.groupBy("path").agg(F.sum(F.col("dx") * F.col("f")).alias("px"), F.sum(F.col("dy") * F.col("f")).alias("py"))


def pulls(positions: DataFrame, links: DataFrame) -> DataFrame:
    """path, px, py: how links(src, dst), each once and both ways, pull notes to SPRING units from each other."""
    a = positions.select(F.col("path").alias("src"), "x", "y")
    b = positions.select(F.col("path").alias("dst"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    met = links.join(a, "src").join(b, "dst").withColumns({"dx": F.col("ox") - F.col("x"), "dy": F.col("oy") - F.col("y")})
    met = met.withColumn("d", F.greatest(F.hypot("dx", "dy"), F.lit(1e-6))).withColumn("f", (F.col("d") - SPRING) / F.col("d") * 0.02)
    return met.groupBy(F.col("src").alias("path")).agg(F.sum(F.col("dx") * F.col("f")).alias("px"), F.sum(F.col("dy") * F.col("f")).alias("py"))


def spread_out(positions: DataFrame, edges: DataFrame, rounds: int = COLLISION_ROUNDS) -> DataFrame:
    """Notes that were fanned out pushed apart and pulled along their links, less each round; a round moves a note by two units at most."""
    links = written(both_ways(edges).where("src <> dst").distinct(), "links")
    out = written(fanned_out(positions), "fanned")
    for k in range(rounds):
        moved = pushes(out).unionByName(pulls(out, links)).groupBy("path").agg(F.sum("px").alias("px"), F.sum("py").alias("py"))
        step = lambda c, p: (F.col(c) + F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.coalesce(p, F.lit(0.0)))) * (1 - k / rounds)).alias(c)  # noqa: B023, E731
        new = written(out.join(moved, "path", "left").select("component", "path", step("x", "px"), step("y", "py")), f"spread{k}")
        removed(out)
        out = new
    removed(links)
    return out


def packed(islands: DataFrame, margin: float = 2.0, rings: int | None = None) -> DataFrame:
    """component, r, x, y of islands(component, n, folder): the largest in the middle, the others on rings around it, by folder and then size, so that none meets another.

    Rings are as wide as the largest of the others. An island's place follows from the sum of the widths before it, which is a
    prefix sum over range partitions: as many components as there may be, no task or driver holds them all. With rings, that many
    are made at most, and what has no room on them goes round the last one again, over those before.
    """
    sized = written(islands.select("component", "folder", (0.8 * F.sqrt(F.col("n").cast("double")) + 1).alias("r")), "islands")
    first = sized.orderBy(F.desc("r"), "component").first()
    if first is None:
        return sized.select("component", "r", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    rest = sized.where(F.col("component") != first["component"])
    widest = rest.agg(F.max("r")).first()[0] or 0.0
    width = 2 * widest + margin
    placed = prefix_sums(rest, (2 * F.col("r") + margin).cast("decimal(28,18)"), F.col("folder"), F.desc("r"), F.col("component"))
    # Ring k is at radius base + k * width; its room is its circumference less one width, so a last island doesn't meet the first.
    base = first["r"] + margin + widest
    room = lambda k: k * (2 * np.pi * base - width) + np.pi * width * k * (k - 1)  # noqa: E731  of the rings before k
    a, b = float(np.pi * width), float(2 * np.pi * base - width - np.pi * width)
    guess = F.floor((F.sqrt(F.lit(b * b) + 4 * a * F.col("before")) - b) / (2 * a)).cast("long")
    ring = F.array_max(F.filter(F.sequence(F.greatest(guess - 1, F.lit(0).cast("long")), guess + 1), lambda k: room(k) <= F.col("before")))
    rows = placed.withColumn("__k", ring if rings is None else F.least(ring, F.lit(rings - 1))).withColumn("__R", base + F.col("__k") * width)
    angle: Column = (F.col("before") - room(F.col("__k")) + F.col("r") + margin / 2) / F.col("__R")
    rows = rows.select("component", "r", (F.cos(angle) * F.col("__R")).alias("x"), (F.sin(angle) * F.col("__R")).alias("y"))
    return rows.unionByName(sized.where(F.col("component") == first["component"]).select("component", "r", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))


def arms(notes: DataFrame, rounds: int = 4, share: float = 0.6) -> DataFrame:
    """path, arm of notes(path, folder): the first folder of each note; one with most of all notes is split into its subfolders, a few times.

    The driver holds the few folders that were split; the rest are counts by prefix.
    """
    parts = F.split("folder", "/")
    keyed = notes.select("path", "folder", parts[0].alias("arm"))
    n, done = keyed.count(), []
    for _ in range(rounds):
        top = keyed.groupBy("arm").agg(F.count("*").alias("n"), F.bool_or(F.size(parts) > F.size(F.split("arm", "/"))).alias("deeper")).orderBy(F.desc("n"), "arm").first()
        if top is None or top["n"] < share * n or not top["arm"] or top["arm"] in done or not top["deeper"]:
            break
        done.append(top["arm"])
        depth = top["arm"].count("/") + 1
        keyed = keyed.withColumn("arm", F.when((F.col("arm") == top["arm"]) & (F.size(parts) > depth), F.concat_ws("/", "arm", F.get(parts, F.lit(depth)))).otherwise(F.col("arm")))
    return keyed.select("path", "arm")
