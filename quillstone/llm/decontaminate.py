"""Benchmark decontamination with a positional inverted index.

The test items are a stated query set: blocks of about BLOCK_CHARS of their text, by a hash of their ids, are taken one
after the other, and the digests and counts of a block's distinct words, 16 bytes each, go to the driver and the tasks;
the items themselves stay in tasks. Training texts are read twice: once to count how often each test term occurs, once to
store the postings of the terms that windows start from. Each window of WINDOW words starts from its
rarest term; a posting is a row of the document, the position and the terms of the words around it, so the lists of a
window's other terms, adjusted by their offsets, are intersected where the rarest one stands. Exact phrases and proximity
matches (the two rarest terms of a window within REACH words) come from one join of postings and distinct test places.
Hit words are counted by blocks of HIT_BLOCK words, in each of which the matches' intervals are merged, so no row and no
task holds all matches of a text.

Defined results: a null or empty text has no words, and an item without words no window; an item of fewer than WINDOW
words is one window; items of equal text each count; null item_ids are left out; rows of equal doc_id and text have
equal results; an empty benchmark gives documents without hits; an empty documents table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, free_names, read, release, utf8_buffer
from quillstone.llm.spans import byte_table, owners, runs, span_digests
from quillstone.llm.token_counts import batches

WINDOW = 13
REACH = WINDOW - 1
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: Characters of test items in a block; their terms and windows are what the driver and the tasks hold.
BLOCK_CHARS = 20_000_000
BATCH_BYTES = 2_000_000
#: Windows of an item that are worked on at once, and postings that are handed on together.
PIECE, POSTINGS = 100_000, 20_000
#: Words in a block whose hits are counted together; a power of two, longer than any match.
HIT_BLOCK = 1024

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A digest of each word of each text, and the offsets of the texts in words."""
    data, offsets = utf8_buffer(texts)
    data = LOWER[data]
    starts, ends = runs(IN_WORD[data], offsets)
    return span_digests(data, starts, ends), np.searchsorted(starts, offsets)


def vocabulary_of(items: DataFrame) -> np.ndarray:
    """The sorted digests of the items' distinct words."""

    def distinct(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tables:
            for _, part in batches(b.column("text"), BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(words(part)[0]).view(np.int64))], ["word"])

    found = items.select("text").mapInArrow(distinct, "word long").distinct().toPandas()["word"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def anchors(terms: np.ndarray, counts: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Of an item's terms: the words of its windows; the places that windows start from, the rarest term of each window; the
    terms around each place (-2 outside the item); and the other of its window's two rarest terms (-3 if there is none)."""
    size = min(WINDOW, len(terms))
    windows = np.lib.stride_tricks.sliding_window_view(terms, size)
    order = np.argsort(counts[windows], axis=1, kind="stable")
    first = np.arange(len(windows)) + order[:, 0]
    ranked = np.take_along_axis(windows, order, axis=1)
    differs = ranked != ranked[:, :1]
    other = np.where(differs.any(axis=1), np.take_along_axis(ranked, differs.argmax(axis=1)[:, None], axis=1)[:, 0], -3)
    place, at = np.unique(first, return_index=True)
    padded = np.concatenate([np.full(REACH, -2), terms, np.full(REACH, -2)])
    return size, place, padded[place[:, None] + np.arange(2 * REACH + 1)], other[at]


def test_places(items: DataFrame, vocabulary: np.ndarray, counts: np.ndarray) -> DataFrame:
    """term, item_id, size, wanted, other: a row for each place that windows of items(item_id, text) start from."""
    shared = items.sparkSession.sparkContext.broadcast((vocabulary, counts))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, counts = shared.value
        for b in tables:
            for at, part in batches(b.column("text"), BATCH_BYTES):
                hashes, ends = words(part)
                terms = np.searchsorted(vocabulary, hashes)
                for k, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    # A long item is worked on by pieces that overlap by a window.
                    for low in range(i, max(j - WINDOW + 1, i + (j > i)), PIECE):
                        own = terms[max(low - REACH, i) : min(low + PIECE + 2 * REACH, j)]
                        size, place, wanted, other = anchors(own, counts)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(own[place].astype(np.int32)), pa.array([b.column("item_id")[at + k].as_py()] * len(place), pa.string()), pa.array(np.full(len(place), size, np.int32)),
                                pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1, dtype=np.int32) * (2 * REACH + 1)), pa.array(wanted.reshape(-1).astype(np.int32))), pa.array(other.astype(np.int32)),
                            ],
                            ["term", "item_id", "size", "wanted", "other"],
                        )

    return items.mapInArrow(run, "term int, item_id string, size int, wanted array<int>, other int")


def numbered(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """The number of each word in the vocabulary, -1 if it is not there."""
    out = np.full(len(hashes), -1, np.int32)
    for i in range(0, len(hashes) if len(vocabulary) else 0, PIECE):
        some = hashes[i : i + PIECE]
        at = np.minimum(np.searchsorted(vocabulary, some), len(vocabulary) - 1)
        out[i : i + PIECE] = np.where(vocabulary[at] == some, at, -1)
    return out


def term_counts(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each term occurs in all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value) + 1, np.int64)
        for b in tables:
            for _, part in batches(b.column("text"), BATCH_BYTES):
                total += np.bincount(numbered(words(part)[0], shared.value) + 1, minlength=len(total))
        seen = np.flatnonzero(total[1:])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[1:][seen])], ["term", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    found = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out[found["term"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def postings(docs: DataFrame, vocabulary: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """doc_id, text_hash, n_words, term, pos, around array<int> of docs(doc_id, text_hash, text): a row with n_words for each document, and
    rows with the others for each occurrence of a wanted term."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, wanted))
    span = np.arange(-REACH, REACH + 1)

    def index(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, wanted = shared.value
        names = ["doc_id", "text_hash", "n_words", "term", "pos", "around"]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
        for b in tables:
            for at, part in batches(b.column("text"), BATCH_BYTES):
                hashes, ends = words(part)
                terms = numbered(hashes, vocabulary)
                del hashes
                own = [b.column(c).slice(at, len(part)) for c in names[:2]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(ends).astype(np.int64)), *(pa.nulls(len(part), k) for k in kinds[1:])], names)
                every = np.flatnonzero((terms >= 0) & wanted[terms]) if len(wanted) else np.zeros(0, np.int64)
                for i in range(0, len(every), POSTINGS):
                    here = every[i : i + POSTINGS]
                    text = owners(ends, here)
                    near = here[:, None] + span
                    inside = (near >= ends[text][:, None]) & (near < ends[text + 1][:, None])
                    around = np.where(inside, terms[np.clip(near, 0, len(terms) - 1)], np.int32(-1))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(here) + 1, dtype=np.int32) * len(span)), pa.array(around.reshape(-1)))
                    row = pa.array(text)
                    yield pa.RecordBatch.from_arrays([*(c.take(row) for c in own), pa.nulls(len(here), kinds[0]), pa.array(terms[here]), pa.array((here - ends[text]).astype(np.int32)), lists], names)
        release()

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, n_words long, term int, pos int, around array<int>"
    return docs.select("doc_id", "text_hash", "text").mapInArrow(index, schema)


def matches(index: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, text_hash, place, low, high (positions of an exact match, null if none), near: a row for each meeting of a posting and one of
    places(term, size, wanted, other, place) that matches."""
    met = index.where("term is not null").drop("n_words").join(places, "term")
    same = F.array_join(F.zip_with("around", "wanted", lambda a, b: F.when(a == b, "1").otherwise("0")), "")
    met = met.withColumn("same", same)
    left = F.length(F.regexp_extract(F.reverse(F.substring("same", 1, REACH)), "^1*", 0))
    right = F.length(F.regexp_extract(F.substring("same", REACH + 2, REACH), "^1*", 0))
    met = met.withColumns({"left": left, "right": right, "near": F.array_contains("around", F.col("other"))})
    exact = F.col("left") + F.col("right") + 1 >= F.col("size")
    return met.where(exact | F.col("near")).select(
        "doc_id", "text_hash", "place", F.when(exact, F.col("pos") - F.col("left")).alias("low"), F.when(exact, F.col("pos") + F.col("right")).alias("high"), "near"
    )


def hit_words(found: DataFrame) -> DataFrame:
    """h_doc_id, h_text_hash, n_hit: the words inside the intervals of matches(), each counted once."""
    block = lambda c: F.floor(F.col(c) / HIT_BLOCK)
    runs = found.where("low is not null").select("doc_id", "text_hash", F.explode(F.array_distinct(F.array(block("low"), block("high")))).alias("block"), "low", "high")
    own = F.struct(F.greatest("low", F.col("block") * HIT_BLOCK).alias("low"), F.least("high", F.col("block") * HIT_BLOCK + HIT_BLOCK - 1).alias("high"))
    merged = F.aggregate(
        F.array_sort(F.collect_set(own)),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end")),
        lambda acc, r: F.struct((acc["n"] + F.greatest(r["high"] - F.greatest(acc["end"], r["low"] - 1), F.lit(0))).alias("n"), F.greatest(acc["end"], r["high"]).alias("end")),
    )
    blocks = runs.groupBy("doc_id", "text_hash", "block").agg(merged["n"].alias("n"))
    return blocks.groupBy(F.col("doc_id").alias("h_doc_id"), F.col("text_hash").alias("h_text_hash")).agg(F.sum("n").alias("n_hit"))


def blocks(benchmark: DataFrame) -> Iterator[DataFrame]:
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_CHARS))
    for k in range(n):
        yield items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)


def judged(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, item_ids, near_ids, contaminated for docs(doc_id, text)."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    key, own = ["doc_id", "text_hash"], ["term", "size", "wanted", "other"]
    found, pairs, sizes = None, None, None
    for k, items in enumerate(blocks(benchmark)):
        vocabulary = vocabulary_of(items)
        counts = term_counts(docs, vocabulary) if len(vocabulary) else np.zeros(0, np.int64)
        places = test_places(items, vocabulary, counts).withColumn("place", F.sha2(F.concat_ws(" ", F.lit(k), "term", "size", F.concat_ws(",", F.col("wanted").cast("array<string>")), "other"), 256))
        places = scratch.table(places, f"places{k}")
        distinct = scratch.table(places.select("place", *own).dropDuplicates(["place"]), f"distinct{k}")
        wanted = np.zeros(len(vocabulary), bool)
        wanted[distinct.select("term").distinct().toPandas()["term"].to_numpy(np.int64)] = True
        index = scratch.table(postings(docs, vocabulary, wanted), f"index{k}")
        met = scratch.table(matches(index, distinct), f"matches{k}")
        each = met.groupBy(*key, "place").agg(F.bool_or(F.col("low").isNotNull()).alias("exact"), F.bool_or("near").alias("near"))
        each = each.join(places.select("place", "item_id").distinct(), "place").drop("place")
        found = met if found is None else found.unionByName(met)
        pairs = each if pairs is None else pairs.unionByName(each)
        sizes = index.where("n_words is not null").select(*key, "n_words") if sizes is None else sizes
    ids = [F.array_sort(F.collect_set(F.when(F.col(c), F.col("item_id")))).alias(name) for c, name in (("exact", "item_ids"), ("near", "near_ids"))]
    items = pairs.groupBy(*key).agg(*ids).withColumnsRenamed({c: f"i_{c}" for c in key})
    null_safe = lambda p: F.col("doc_id").eqNullSafe(F.col(f"{p}_doc_id")) & (F.col("text_hash") == F.col(f"{p}_text_hash"))
    out = sizes.join(hit_words(found), null_safe("h"), "left").join(items, null_safe("i"), "left")
    none = F.array().cast("array<string>")
    out = out.select(*key, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("near_ids", none).alias("near_ids"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), Scratch(spark, "decontaminate"))
    return done.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated", F.size("near_ids").cast("long").alias("n_near_items")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, with their columns."""
    done = judged(docs, read(spark, sf_dir, "benchmark"), Scratch(spark, "decontaminate"))
    id_, hash_ = free_names(docs, "gone_id", "gone_hash")
    gone = done.where("contaminated").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_)), "left_anti")
