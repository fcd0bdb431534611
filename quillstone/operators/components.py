"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.sources.scratch import removed


def star_forest(links: DataFrame, written: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """node, root for each node of links(a, b) that is not the smallest of its component.

    Large-star and small-star rounds (Kiveris et al., 2014): every node hands its neighbours its smallest one, until nothing
    changes. Minima are taken before rows meet, and the minima of all nodes are written, so that both sides of the joins
    with them are dealt out for it alone and AQE can split a node with very many links.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "round0")
    sign = lambda t: t.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    seen = sign(edges)
    for k in count(1):
        if not seen["n"]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"large{k}")
        large = both.join(nearest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), f"small{k}")
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        new = written(small, f"round{k}")
        removed(edges, nearest, least)
        edges = new
        now = sign(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
