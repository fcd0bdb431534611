"""The link graph as tables: edges(src, dst), nodes(path)."""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.operators.components import star_forest
from quillstone.operators.ranks import exact_median
from quillstone.sources.scratch import removed, written


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(edges: DataFrame) -> DataFrame:
    """path, degree: links in and out. Summed within tasks before the shuffle, so a hub is no large group."""
    return edges.select(F.explode(F.array("src", "dst")).alias("path")).groupBy("path").agg(F.count("*").alias("degree"))


def labelled(edges: DataFrame, most: int = 5000) -> DataFrame:
    """path, degree of the best-linked notes, which get labels first."""
    return degrees(edges).orderBy(F.desc("degree"), "path").limit(most)


def found(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose name contains the text; none for a blank one."""
    asked = text.strip().lower()
    name = F.lower(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1))
    return nodes.where(F.contains(name, F.lit(asked)) if asked else F.lit(False))


def without_hubs(edges: DataFrame, cap: int = 1000) -> DataFrame:
    """Edges that touch no node of more links than the cap."""
    hubs = degrees(edges).where(F.col("degree") > cap).select("path")
    return edges.join(hubs, edges["src"] == hubs["path"], "left_anti").join(hubs, edges["dst"] == hubs["path"], "left_anti")


def neighbourhood(edges: DataFrame, start: str, hops: int | None) -> DataFrame:
    """path, hop of what is within so many links of a note, either way; with None, of all that can be reached."""
    links = both_ways(edges).distinct()
    if hops is None:
        links = written(links, "links")
    reached = edges.sparkSession.createDataFrame([(start, 0)], "path string, hop int")
    front = reached
    for k in count(1) if hops is None else range(1, hops + 1):
        nearby = front.join(links, front["path"] == links["src"]).select(F.col("dst").alias("path")).distinct()
        front = written(nearby.join(reached, "path", "left_anti").withColumn("hop", F.lit(k)), f"hop{k}")
        if hops is None and front.isEmpty():
            break
        reached = reached.unionByName(front)
        if k % 20 == 0:
            reached = written(reached, f"reached{k}")  # keeps the plan short in long chains
    return reached


def components(edges: DataFrame) -> DataFrame:
    """path, component (the least path in it) of every node with a link to another.

    A node whose only neighbour has a smaller path has that one's component. Such leaves, most nodes of many graphs, take no
    part in the rounds and get their component in the end.
    """
    pairs = written(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a <> b").distinct(), "pairs")
    one = pairs.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")).where("n = 1")
    leaves = written(one.join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_anti").select("a", "b"), "leaves")
    forest = star_forest(pairs.join(leaves.select("a"), "a", "left_anti"), written)
    roots = forest.select(F.col("root").alias("path")).distinct()
    core = forest.select(F.col("node").alias("path"), F.col("root").alias("component")).unionByName(roots.select("path", F.col("path").alias("component")))
    # What only leaves are linked to is the least of its component.
    middles = leaves.select(F.col("b").alias("path")).distinct().join(core, "path", "left_anti")
    core = written(core.unionByName(middles.select("path", F.col("path").alias("component"))), "core")
    removed(pairs, forest)
    return core.unionByName(leaves.join(core, F.col("b") == F.col("path")).select(F.col("a").alias("path"), "component"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.explode(F.array("src", "dst")).alias("path")), "path", "left_anti")


def component_folder(labels: DataFrame, folder: Column) -> DataFrame:
    """component, folder, n: the folder that most of a component's notes are in."""
    counts = labels.select("component", folder.alias("folder")).groupBy("component", "folder").agg(F.count("*").alias("n"))
    return counts.groupBy("component").agg(F.max_by("folder", F.struct("n", "folder")).alias("folder"), F.max("n").alias("n"))


def raster(points: DataFrame, size: int) -> DataFrame:
    """px, py, n: points(x, y in 0 to 1) on a grid of so many cells a side."""
    cell = lambda c: F.least(F.greatest(F.floor(F.col(c) * size), F.lit(0)), F.lit(size - 1)).cast("int")
    return points.groupBy(cell("x").alias("px"), cell("y").alias("py")).agg(F.count("*").alias("n"))


def line_raster(lines: DataFrame, size: int) -> DataFrame:
    """px, py, n: cells that lines(x1, y1, x2, y2) pass, by equal steps along the longer axis."""
    steps = F.greatest(F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) * size), F.lit(1))
    at = lines.withColumn("steps", steps).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps"))))
    t = F.col("k") / F.col("steps")
    return raster(at.select((F.col("x1") + (F.col("x2") - F.col("x1")) * t).alias("x"), (F.col("y1") + (F.col("y2") - F.col("y1")) * t).alias("y")), size)


def placed(new: DataFrame, edges: DataFrame, positions: DataFrame, anchors: DataFrame) -> DataFrame:
    """path, x, y of new(path, folder): the mean of neighbours that have a place, else the folder's anchor."""
    near = both_ways(edges).join(positions.withColumnRenamed("path", "dst"), "dst").groupBy(F.col("src").alias("path")).agg(F.avg("x").alias("nx"), F.avg("y").alias("ny"))
    return new.join(near, "path", "left").join(anchors.select("folder", F.col("x").alias("ax"), F.col("y").alias("ay")), "folder", "left").select("path", F.coalesce("nx", "ax", F.lit(0.5)).alias("x"), F.coalesce("ny", "ay", F.lit(0.5)).alias("y"))


def folder_anchors(positions: DataFrame, folder: Column) -> DataFrame:
    return positions.groupBy(folder.alias("folder")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))


def folder_ranks(nodes: DataFrame, folder: Column) -> DataFrame:
    """folder, n, rank: folders by size, then name. The window runs over folders, after they are counted."""
    counts = nodes.groupBy(folder.alias("folder")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "folder")))


def median_link_length(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """median and links, of links with both ends placed."""
    a = positions.select(F.col("path").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = positions.select(F.col("path").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    length = F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"))
    lengths = written(edges.join(a, "src").join(b, "dst").select(length.alias("length")), "lengths")
    return lengths.agg(F.lit(exact_median(lengths, F.col("length"))).cast("double").alias("median"), F.count("*").alias("links"))


def ranked(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """rows with k, their place within the group from 0. A global sort gives it, with the group's rows in earlier partitions counted before, so a group of any size has no window or task of its own."""
    at = written(rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(group, *order).withColumn("__id", F.monotonically_increasing_id()), "ranked")
    at = at.withColumn("__part", F.shiftright("__id", 33))
    counts = at.groupBy(F.col(group).alias("__of"), F.col("__part").alias("__p")).agg(F.min("__id").alias("__first_id"), F.count("*").alias("__n"))
    counts = counts.withColumn("__before", F.sum("__n").over(W.partitionBy("__of").orderBy("__p")) - F.col("__n")).drop("__n")
    return at.join(counts, at[group].eqNullSafe(counts["__of"]) & (at["__part"] == counts["__p"])).select(*rows.columns, (F.col("__id") - F.col("__first_id") + F.col("__before")).alias("k"))


def small_layouts(members: DataFrame) -> DataFrame:
    """path, component, x, y: sunflower placement within each component of members(component, path, degree), of any size, hubs in the middle. The place follows from the rank alone."""
    # The range partitioner reads its rows twice: they are written before.
    places = ranked(written(members.select("component", "path", "degree"), "members"), "component", F.desc("degree"), F.col("path"))
    angle, radius = F.col("k") * float(np.pi * (3 - np.sqrt(5))), F.sqrt(F.col("k").cast("double"))
    return places.select("path", "component", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))


def spliced(edges: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """edges with the rows of changed(path) replaced by new(src, dst, ord)."""
    return edges.join(changed.select(F.col("path").alias("src")), "src", "left_anti").unionByName(new)


def inlink_counts(edges: DataFrame) -> DataFrame:
    """path, n: distinct notes that link to it, counted as pairs."""
    return edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("n"))


def adjacency(edges: DataFrame, size: int = 10_000) -> DataFrame:
    """path, block, outlinks (in written order), inlinks (by path): so many of each at most in a block, so a hub has several rows, numbered from 0."""
    out = ranked(edges.select(F.col("src").alias("path"), "ord", "dst"), "path", F.col("ord"), F.col("dst"))
    into = ranked(edges.select(F.col("dst").alias("path"), "src").distinct(), "path", F.col("src"))
    block = F.floor(F.col("k") / size).alias("block")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("k", c))), lambda x: x[c])
    out, into = out.groupBy("path", block).agg(listed("dst").alias("outlinks")), into.groupBy("path", block).agg(listed("src").alias("inlinks"))
    none = F.array().cast("array<string>")
    return out.join(into, ["path", "block"], "full").select("path", "block", F.coalesce("outlinks", none).alias("outlinks"), F.coalesce("inlinks", none).alias("inlinks"))


def embedded(edges: DataFrame, start: str, levels: int = 3) -> DataFrame:
    """path, level of what a note embeds, and what that embeds, along edges only."""
    links = edges.select("src", "dst").distinct()
    reached = edges.sparkSession.createDataFrame([(start, 0)], "path string, level int")
    front = reached
    for k in range(1, levels + 1):
        nearby = front.join(links, front["path"] == links["src"]).select(F.col("dst").alias("path")).distinct()
        front = written(nearby.join(reached, "path", "left_anti").withColumn("level", F.lit(k)), f"level{k}")
        reached = reached.unionByName(front)
    return reached


def nearest(points: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """q, path, distance: the nearest of points(path, x, y) to each of queries(q, x, y) within the radius.

    By cells, fine ones first: what is nearest within a smaller radius is nearest at all, so only queries without such a point
    go on to wider cells, and a query meets few points however dense they are.
    """
    # Of points in one place the first by path counts.
    points = written(points.groupBy("x", "y").agg(F.min("path").alias("path")), "points")
    rest, found = queries.select("q", "x", "y"), []
    for share in (4096, 512, 64, 8, 1):
        # A little within the cells' size, so that no rounding of a cell loses a point.
        near = written(met_in_cells(points, rest, radius / share, radius / share * (0.999 if share > 1 else 1)), f"nearest{share}")
        rest = rest.join(near.select(F.col("q").alias("__q")), F.col("q").eqNullSafe(F.col("__q")), "left_anti")
        found.append(near)
    return reduce(DataFrame.unionByName, found)


def met_in_cells(points: DataFrame, queries: DataFrame, size: float, radius: float) -> DataFrame:
    """nearest() within a radius that is the cells' size at most, over the points of nine cells a query."""
    cell = lambda c: F.floor(F.col(c) / size)
    around = F.explode(F.flatten(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda j: F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy"))))))
    wanted = queries.select("q", F.col("x").alias("qx"), F.col("y").alias("qy"), around.alias("c")).select("q", "qx", "qy", "c.cx", "c.cy")
    met = points.withColumns({"cx": cell("x"), "cy": cell("y")}).join(wanted, ["cx", "cy"])
    met = met.withColumn("distance", F.hypot(F.col("x") - F.col("qx"), F.col("y") - F.col("qy"))).where(F.col("distance") <= radius)
    return met.groupBy("q").agg(F.min(F.struct("distance", "path")).alias("m")).select("q", "m.path", "m.distance")


def galaxy(notes: DataFrame, links: DataFrame, now: Column, arms: int = 6) -> DataFrame:
    """path, arm, x, y, size, alpha of notes(path, folder, mtime): arms by the largest folders, places by hash, size by links, fading with age."""
    big = [r["folder"] for r in notes.groupBy("folder").count().orderBy(F.desc("count"), "folder").limit(arms).collect()]
    arm = F.coalesce(*[F.when(F.col("folder") == f, F.lit(i)) for i, f in enumerate(big)], F.lit(len(big)))
    part = lambda k: F.conv(F.substring(F.md5(F.concat_ws("|", "path", F.lit(k))), 1, 8), 16, 10).cast("double") / 2.0**32
    radius = F.sqrt(part(1))
    angle = arm * float(2 * np.pi / max(len(big), 1)) + radius * 2.0 + (part(2) - 0.5) * 0.6
    age = F.greatest(F.datediff(now, "mtime"), F.lit(0))
    placed_ = notes.join(degrees(links), "path", "left")
    return placed_.select("path", arm.alias("arm"), (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"), (1 + F.log1p(F.coalesce("degree", F.lit(0)))).alias("size"), F.greatest(1 - age / 365.0, F.lit(0.15)).alias("alpha"))
