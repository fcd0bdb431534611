"""SimHash near-duplicates with BK-trees.

A fingerprint has a bit for each bit that is set in over half the XXH64 values of a text's 3-word shingles. Two distinct
fingerprints of at most RADIUS differing bits agree in at least one of RADIUS + 1 bands of bits, so only fingerprints that
agree in a band meet. Those of one band value are a shard: a BK-tree, children keyed by their Hamming distance to the
parent, which is searched for each of its members along the edges within the radius. A shard beyond SHARD members is
split, and each pair of its parts is a tree and its queries, so no task holds more than two parts. A search joins members
in a forest and hands on one link a member, not all pairs.

Trees of a whole corpus have no size bound and are not broadcast: a tree travels by shuffle to the only task with queries
that can match in it.

Defined results: null texts and those without words have fingerprint zero and are linked like others; fewer than three
words are one shingle; repeated rows and copies share a component; a null doc_id counts for no component_id unless all
of its component are null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, free_names, read, release
from quillstone.llm.components import local_roots, star_forest
from quillstone.llm.token_counts import batches

RADIUS, WORDS, SEED = 2, 3, 42
#: First bit and number of bits of each band.
BANDS = ((0, 22), (22, 21), (43, 21))
SHARD = 20_000
BATCH_BYTES, BATCH_SHINGLES = 8_000_000, 200_000
SPACE = re.compile(rb"[\x09-\x0d ]")
#: Texts over so many bytes are worked on by pieces of about that size.
LONG = 1_000_000
#: Queries that walk a tree at the same time.
WALKERS = 50_000


def window_hashes(words: list[bytes]) -> list[int]:
    """Of each WORDS words in a row."""
    from xxhash import xxh64_intdigest

    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    return [xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts[: len(words) - WORDS + 1].tolist(), (ends[WORDS - 1 :] - 1).tolist(), strict=True)]


def shingle_hashes(text: bytes) -> list[int]:
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, and cut at space and U+0009 to U+000D
    if not words:
        return []
    return window_hashes(words) if len(words) >= WORDS else [xxh64_intdigest(b" ".join(words), SEED)]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """A fingerprint of each list."""
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.fromiter((h for x in hashes for h in x), np.uint64, int(sizes.sum()))
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(sizes) - sizes)[full]
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * counts > sizes[full][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def long_fingerprint(text: bytes) -> int:
    """The fingerprint of a long text, a piece at a time: pieces end at white space and begin with the last words before them."""
    counts, n, at, carried = np.zeros(64, np.int64), 0, 0, []
    while at < len(text):
        cut = SPACE.search(text, min(at + LONG, len(text)))
        to = cut.start() if cut else len(text)
        words = carried + text[at:to].lower().split()
        if len(words) >= WORDS:
            hashes = np.array(window_hashes(words), np.uint64)
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(hashes)
        carried, at = words[1 - WORDS :], to
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0]) if n else int(majority([shingle_hashes(text)])[0])


def row_key() -> tuple[Column, Column]:
    """128 bits of the id and the whole text, which tell rows apart and are never null."""
    return F.xxhash64("doc_id", "text"), F.xxhash64("text", "doc_id", F.lit(1))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to doc_id, fp long (the fingerprint's bits), key_a and key_b (see row_key)."""
    key_a, key_b = row_key()

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tables:
            for at, part in batches(b.column("text"), BATCH_BYTES):
                out, held, n = [], [], 0
                for text in pc.fill_null(part, "").cast(pa.binary()).to_pylist():
                    if len(text) > LONG:
                        out += [majority(held), np.array([long_fingerprint(text)], np.uint64)]
                        held, n = [], 0
                        continue
                    held.append(shingle_hashes(text))
                    n += len(held[-1])
                    if n >= BATCH_SHINGLES:
                        out.append(majority(held))
                        held, n = [], 0
                out.append(majority(held))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(at, len(part)) for c in ("doc_id", "key_a", "key_b")), pa.array(np.concatenate(out).view(np.int64))], ["doc_id", "key_a", "key_b", "fp"])
        release()

    rows = docs.select("doc_id", "text", key_a.alias("key_a"), key_b.alias("key_b"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key_a long, key_b long, fp long")


class Forest:
    """BK-trees of many shards at once, as arrays: a node is an item, and an edge is a child's distance to its parent."""

    def __init__(self, fp: np.ndarray, shard: np.ndarray):
        """shard: of each item, from 0."""
        self.fp = fp
        n = len(fp)
        self.root = np.full(int(shard.max()) + 1 if n else 0, -1, np.int64)
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        at, group = np.arange(n), shard.astype(np.int64)
        over = np.full(n, -1, np.int64)  # the node above each item still to be placed
        distance = np.zeros(n, np.int64)
        while len(at):
            order = np.argsort(group, kind="stable")
            at, group, over, distance = at[order], group[order], over[order], distance[order]
            first = np.ones(len(at), bool)
            first[1:] = group[1:] != group[:-1]
            parent[at[first]], edge[at[first]] = over[first], distance[first]
            node = at[first][np.cumsum(first) - 1]
            rest = ~first
            at, over = at[rest], node[rest]
            distance = np.bitwise_count(fp[at] ^ fp[over]).astype(np.int64)
            group = over * 65 + distance
        tops = parent < 0
        self.root[shard[tops]] = np.flatnonzero(tops)
        self.children = np.flatnonzero(~tops)
        keys = parent[self.children] * 65 + edge[self.children]
        order = np.argsort(keys)
        self.keys, self.children = keys[order], self.children[order]

    def search(self, fp: np.ndarray, shard: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) within the radius in each query's shard, a level of the trees at a time."""
        for k in range(0, len(fp), WALKERS):
            query = np.arange(k, min(k + WALKERS, len(fp)))
            node = self.root[shard[query]]
            query, node = query[node >= 0], node[node >= 0]
            while len(query):
                d = np.bitwise_count(fp[query] ^ self.fp[node]).astype(np.int64)
                near = d <= radius
                if near.any():
                    yield query[near], node[near]
                low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0), "left")
                high = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right")
                n = high - low
                query = np.repeat(query, n)
                node = self.children[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def linked(fp: np.ndarray, shard: np.ndarray, is_tree: np.ndarray, is_query: np.ndarray) -> np.ndarray:
    """The index of a smallest item that each is joined with through links of its shard."""
    trees, queries = np.flatnonzero(is_tree), np.flatnonzero(is_query)
    roots = np.arange(len(fp))
    for q, t in Forest(fp[trees], shard[trees]).search(fp[queries], shard[queries], RADIUS):
        roots = local_roots(roots, queries[q], trees[t])
    return roots


def shard_links(members: DataFrame) -> DataFrame:
    """a, b: links of fingerprints that connect what members(band, key, low, high, fp, tree, query) links, shard by shard."""

    def solve(cols: list[np.ndarray]) -> pa.RecordBatch:
        *keys, fp, tree, query = cols
        new = np.ones(len(fp), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        roots = linked(fp.view(np.uint64), np.cumsum(new) - 1, tree, query)
        own = np.flatnonzero(roots != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[roots[own]])], ["a", "b"])

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in tables:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            # All but the last shard of what is held is complete.
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in cols[:4]], axis=0)) if len(cols[0]) > 1 else np.zeros(0, int)
            if len(change):
                cut = change[-1] + 1
                yield solve([np.concatenate([*(h[i] for h in held), c[:cut]]) for i, c in enumerate(cols)])
                held = [[c[cut:] for c in cols]]
            elif len(cols[0]):
                held.append(cols)
        if held:
            yield solve([np.concatenate([h[i] for h in held]) for i in range(7)])

    return members.select("band", "key", "low", "high", "fp", "tree", "query").mapInArrow(run, "a long, b long")


def banded(fps: DataFrame) -> DataFrame:
    """Members of the shards of fps(fp), in the order of their shards."""
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1)).alias("key")) for i, (first, bits) in enumerate(BANDS)])
    rows = fps.select("fp", F.explode(bands).alias("b")).select("b.band", "b.key", "fp")
    sizes = rows.groupBy("band", "key").count().where("count > 1")
    parts = F.ceil(F.col("count") / SHARD).cast("long")
    rows = rows.join(sizes, ["band", "key"]).withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("band", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp", (F.col("own") <= F.col("other")).alias("tree"), (F.col("own") >= F.col("other")).alias("query"))
    order = ["band", "key", "low", "high"]
    return rows.repartition(*order).sortWithinPartitions(*order)


def near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, key_a, key_b, fp, component (a fingerprint of it) and component_id for docs(doc_id, text)."""
    own = scratch.table(fingerprints(docs), "fingerprints")
    fps = scratch.table(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    forest = star_forest(shard_links(banded(fps)), scratch)
    # Of linked fingerprints only: the smallest doc_id of each component.
    members = forest.unionByName(forest.select(F.col("root").alias("node"), "root")).distinct()
    with_ids = members.join(fps.withColumnRenamed("fp", "node"), "node")
    smallest = with_ids.groupBy("root").agg(F.min("least").alias("smallest"))
    smallest = with_ids.join(smallest, "root").select(F.col("node").alias("fp"), "root", "smallest")
    of = fps.join(smallest, "fp", "left").select("fp", F.coalesce("root", "fp").alias("component"), F.coalesce("smallest", "least").alias("component_id"))
    # Written, so that the join's both sides are dealt out for it alone and AQE can split a fingerprint that many rows have.
    of = scratch.table(of, "components")
    scratch.keep("fingerprints", "components")
    return own.join(of, "fp", "left")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = near_duplicates(read(spark, sf_dir, "documents"), Scratch(spark, "simhash"))
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of each component with its columns: one with the smallest doc_id, of texts under that id any one."""
    done = near_duplicates(docs, Scratch(spark, "simhash"))
    a, b = free_names(docs, "key_a", "key_b")
    kept = done.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min(F.struct("key_a", "key_b")).alias("k"))
    kept = kept.select(F.col("k.key_a").alias(a), F.col("k.key_b").alias(b))
    key_a, key_b = row_key()
    return docs.withColumns({a: key_a, b: key_b}).join(kept, [a, b], "left_semi").dropDuplicates([a, b]).select(*docs.columns)
