"""Exact-substring dedup: every byte covered by a LENGTH-byte string that also starts elsewhere is removed.

Suffixes are sorted a bucket at a time, and long ties are resolved by ranks of cover samples that were worked out before,
so a task holds the suffixes of a few buckets and no whole suffix array exists anywhere.

* Buckets. The anchor of a LENGTH-byte string is its K-byte substring of least hash, the leftmost of equals. Equal strings
  have equal anchors at equal distances, so strings that can be equal share a bucket, the anchor's hash. Buckets with one
  anchor are dropped before any text moves; texts without a repeated anchor are never shuffled again.
* Cover. Suffixes of a bucket that can tie over LENGTH bytes start at the same distance from their anchors, so their
  differences are multiples of the period STEP and the cover needs one residue: positions a multiple of STEP from the
  anchor. Samples there are ranked by 1, 2, 4, 8 and 9 blocks of STEP bytes, by doubling. A suffix is ordered by the
  sample rank it reaches first and by the STEP bytes that this sample does not cover.
* Exact copies of a text, by SHA-256, are one text with a count. Of a bucket with more than HOT anchors, equal contexts are
  counted first and take part once. What is left of it is split by halves of the distances again and again: all strings of
  so many distances share the bytes in their middle, which tell a half's buckets apart. Equal parts lose all of their strings
  and one of them goes on, so of near copies only the parts that differ are split again. Buckets of one are dropped, those
  of HOT or fewer are sorted, the rest is split further, at last into single strings, which are counted. Strings that only
  share a line with very many others part from them on the way, so no task ever holds more than HOT anchors of a bucket.
  The spans go back to each place by a join that AQE can split.
* Texts are read SLICE bytes at a time, with the bytes of a string more; a run of strings that a slice cuts is two runs.

Defined results: a null text is empty; texts under LENGTH bytes lose nothing; repeated rows are copies of each other; an
empty table gives no rows; strings never cross texts; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, mix64, read, utf8_buffer
from quillstone.llm.spans import BASE, BYTE_VALUES, INVERSE, powers
from quillstone.llm.token_counts import batches

LENGTH, K, STEP = 200, 40, 20
#: Greatest distance from a string's start to its anchor; columns of a context, whose anchor is at column FAR.
FAR = LENGTH - K
WIDTH = FAR + LENGTH
#: Anchors of a bucket that are sorted together in one task.
HOT = 1_000
#: Contexts sorted together.
CONTEXTS = 4_000
BATCH_BYTES = 1_000_000
#: Starts of strings that are looked at together.
SLICE = 4_000_000
#: Low bits of an ordering key that hold the position in a slice.
POSITION = np.uint64((1 << 28) - 1)

KEY = ["text_hash", "n_bytes"]
OCCURRENCE = "text_hash binary, n_bytes long, copies long, anchor long, place long, far int, near int, context binary"


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each run of strings with the same anchor: text, hash of the anchor, its position, first and last start of a string."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    sizes = np.diff(offsets)
    long_ = np.flatnonzero(sizes >= LENGTH)
    if not len(long_):
        return none
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(BASE, n + 1)[:n], out=prefix[1:])
    hashes = (prefix[K:] - prefix[:-K]) * powers(INVERSE, n + 1)[: n - K + 1]
    order = ((hashes * np.uint64(0x9FB21C651E98DF25)) & ~POSITION) | np.arange(len(hashes), dtype=np.uint64)
    w = LENGTH - K + 1
    rows = -(-len(order) // w)
    blocks = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(order)] = order
    blocks = blocks.reshape(rows, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = n - LENGTH + 1
    least = (np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts]) & POSITION).astype(np.int64)
    count = sizes[long_] - LENGTH + 1
    text = np.repeat(long_, count)
    at = np.repeat(offsets[long_] - (np.cumsum(count) - count), count) + np.arange(len(text))
    chosen = least[at]
    first = np.ones(len(at), bool)
    first[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    i = np.flatnonzero(first)
    j = np.append(i[1:], len(at)) - 1
    return text[i], mix64(hashes[chosen[i]]), chosen[i], at[i], at[j]


def sliced_anchors(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """anchors() of a batch, slice by slice; positions are the batch's."""
    if len(data) <= SLICE:
        yield anchors(data, offsets)
        return
    for k, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for i in range(begin, max(end - LENGTH + 1, begin), SLICE):
            own = data[i : min(i + SLICE + LENGTH - 1, end)]
            text, anchor, *places = anchors(own, np.array([0, len(own)]))
            yield (text + k, anchor, *(x + i for x in places))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the key of its text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumns({"text_hash": F.unhex(F.substring(F.sha2("text", 256), 1, 32)), "n_bytes": F.octet_length("text").cast("long")})


def anchor_table(docs: DataFrame) -> DataFrame:
    """KEY, anchor, n: how often each text has each anchor."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tables:
            for at, part in batches(b.column("text"), BATCH_BYTES):
                found = [x[:2] for x in sliced_anchors(*utf8_buffer(part))]
                text, anchor = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                pair = np.stack([text.astype(np.uint64), anchor], axis=1)
                order = np.lexsort((anchor, text))
                pair = pair[order]
                new = np.ones(len(pair), bool)
                new[1:] = (pair[1:] != pair[:-1]).any(axis=1)
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(pair)))
                row = pa.array(pair[first, 0].astype(np.int64) + at)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(row) for c in KEY), pa.array(pair[first, 1].view(np.int64)), pa.array(n)], [*KEY, "anchor", "n"])

    return docs.where(F.col("n_bytes") >= LENGTH).select(*KEY, "text").mapInArrow(run, "text_hash binary, n_bytes long, anchor long, n long")


def occurrences(texts: DataFrame) -> DataFrame:
    """Each repeated anchor of texts(KEY, text, copies, repeated array<long>) with the bytes of all strings it is the anchor of."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tables:
            for at, part in batches(b.column("text"), BATCH_BYTES):
                data, offsets = utf8_buffer(part)
                lists = b.column("repeated").slice(at, len(part))
                wanted = np.unique(lists.flatten().to_numpy(zero_copy_only=False))
                for text, anchor, place, low, high in sliced_anchors(data, offsets):
                    # A hash that another text of the batch repeats only makes a bucket of one.
                    keep = np.isin(anchor.view(np.int64), wanted)
                    text, anchor, place, low, high = (x[keep] for x in (text, anchor, place, low, high))
                    raw = [data[i : j + LENGTH].tobytes() for i, j in zip(low.tolist(), high.tolist(), strict=True)]
                    row = pa.array(text + at)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(b.column(c).take(row) for c in (*KEY, "copies")), pa.array(anchor.view(np.int64)), pa.array(place - offsets[text]),
                            pa.array((place - low).astype(np.int32)), pa.array((place - high).astype(np.int32)), pa.array(raw, pa.binary()),
                        ],
                        [*KEY, "copies", "anchor", "place", "far", "near", "context"],
                    )

    return texts.select(*KEY, "copies", "text", "repeated").mapInArrow(run, OCCURRENCE)


def split(found: DataFrame, size: int) -> DataFrame:
    """occurrences() with a row for each `size` distances, and in place of the anchor a hash of it and of the bytes that all strings of those distances share.

    With a size of 1 these are the strings themselves, and `digest` tells them apart.
    """

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tables:
            far, near, anchor = (b.column(c).to_numpy() for c in ("far", "near", "anchor"))
            parts = far // size - near // size + 1
            row = np.repeat(np.arange(len(far)), parts)
            k = near[row] // size + np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            to, from_ = np.minimum(far[row], k * size + size - 1), np.maximum(near[row], k * size)
            raw = b.column("context").to_pylist()
            shared = [raw[r][i : i + LENGTH - size + 1] for r, i in zip(row.tolist(), (far[row] - k * size).tolist(), strict=True)]
            digests = [hashlib.blake2b(anchor[r].tobytes() + bytes([j]) + x, digest_size=16).digest() for r, j, x in zip(row.tolist(), k.tolist(), shared, strict=True)]
            contexts = [raw[r][i:j] for r, i, j in zip(row.tolist(), (far[row] - to).tolist(), (far[row] - from_ + LENGTH).tolist(), strict=True)]
            keys = [b.column(c).take(pa.array(row)) for c in (*KEY, "copies")]
            ints = [np.frombuffer(b"".join(d[:8] for d in digests), np.int64), b.column("place").to_numpy()[row], to.astype(np.int32), from_.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, ints), pa.array(contexts, pa.binary()), pa.array(digests, pa.binary())], [*b.schema.names, "digest"])

    return found.select(*KEY, "copies", "anchor", "place", "far", "near", "context").mapInArrow(run, f"{OCCURRENCE}, digest binary")


def pair_ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks."""
    flat = np.unique(a.astype(np.int64) * (int(b.max()) + 1) + b, return_inverse=True)[1]
    return flat.reshape(a.shape)


def sorted_buckets(contexts: list[bytes], far: np.ndarray, near: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """For distinct contexts: whether the string at each distance 0 to FAR before the anchor is there twice or more."""
    n = len(contexts)
    text = np.zeros((n, WIDTH), np.uint8)
    for i, c in enumerate(contexts):
        text[i, FAR - far[i] : FAR - far[i] + len(c)] = np.frombuffer(c, np.uint8)
    # Cover samples: ranks of 1, 2, 4, 8 and 9 blocks of STEP bytes.
    one = block_ranks(text)
    two = pair_ranks(one[:, :-1], one[:, 1:])
    four = pair_ranks(two[:, :-2], two[:, 2:])
    eight = pair_ranks(four[:, :-4], four[:, 4:])
    nine = pair_ranks(eight[:, :-1], one[:, 8:])
    out = np.zeros((n, FAR + 1), bool)
    rest = np.zeros((n, 24), np.uint8)
    for distance in range(FAR + 1):
        start = FAR - distance
        sample = -(-start // STEP)
        own = np.flatnonzero((near <= distance) & (far >= distance))
        if not len(own):
            continue
        head = sample * STEP - start
        rest[:, :head] = text[:, start : start + head]
        rest[:, head:STEP] = text[:, start + head + 9 * STEP : start + LENGTH]
        keys = [nine[own, sample], *rest[own].view(np.uint64).T]
        order = np.lexsort(keys)
        new = np.ones(len(own), bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        group = np.cumsum(new) - 1
        out[own[order], distance] = np.bincount(group, weights=copies[own[order]])[group] >= 2
    return out


def block_ranks(text: np.ndarray) -> np.ndarray:
    """Ranks of the blocks of STEP bytes, row by row."""
    n = len(text)
    padded = np.zeros((n, WIDTH // STEP, 24), np.uint8)
    padded[..., :STEP] = text.reshape(n, WIDTH // STEP, STEP)
    words = padded.view(np.uint64).reshape(-1, 3)
    order = np.lexsort(words.T)
    new = np.ones(len(order), bool)
    new[1:] = (words[order][1:] != words[order][:-1]).any(axis=1)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out.reshape(n, -1)


def covered(found: DataFrame) -> DataFrame:
    """KEY, low, high: the bytes of strings that are there twice, from occurrences() sorted by anchor within each task."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        index: dict = {}
        of = np.array([index.setdefault((r[5], r[6], r[3], r[7]), len(index)) for r in rows])
        distinct = list(index)
        copies = np.bincount(of, weights=[r[2] for r in rows])
        near, far = np.array([d[1] for d in distinct]), np.array([d[0] for d in distinct])
        flags = np.zeros((len(distinct), FAR + 1), bool)
        # Buckets with one context need no sorting, and neither do those in which all contexts are there twice.
        bucket = np.unique([d[2] for d in distinct], return_inverse=True)[1]
        open_ = np.flatnonzero((np.bincount(bucket)[bucket] > 1) & (np.bincount(bucket, weights=copies < 2)[bucket] > 0))
        if len(open_):
            flags[open_] = sorted_buckets([distinct[i][3] for i in open_], far[open_], near[open_], copies[open_])
        reach = np.arange(FAR + 1)
        flags |= (copies >= 2)[:, None] & (reach >= near[:, None]) & (reach <= far[:, None])
        edges = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        spans = [(np.flatnonzero(e == 1), np.flatnonzero(e == -1) - 1) for e in edges]
        out = [(r[0], r[1], r[4] - j, r[4] - i + LENGTH) for r, k in zip(rows, of, strict=True) for i, j in zip(*(x.tolist() for x in spans[k]), strict=True)]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), *(pa.int64(),) * 3), strict=True)], [*KEY, "low", "high"])

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for b in tables:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[3] != last and len(held) >= CONTEXTS:
                    yield solve(held)
                    held = []
                last = r[3]
                held.append(r)
        if held:
            yield solve(held)

    found = found.select(*KEY, "copies", "anchor", "place", "far", "near", "context")
    return found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "text_hash binary, n_bytes long, low long, high long")


def covered_hot(found: DataFrame, scratch: Scratch) -> DataFrame:
    """KEY, spans: the same for anchors with very many occurrences. Equal contexts are counted first and take part once, as a
    text of their own with the anchor at 0; what they lose is written, so that both sides of the join that takes it to each
    place are dealt out for it alone and AQE can split a context that is very common."""
    place = ["anchor", "far", "near", "digest"]
    found = scratch.table(found.withColumn("digest", F.sha2("context", 256)), "hot")
    distinct = found.groupBy(*place).agg(F.sum("copies").alias("copies"), F.first("context").alias("context"))
    name = F.unhex(F.sha2(F.concat_ws("|", *place), 256))
    zero = F.lit(0).cast("long")
    distinct = scratch.table(distinct.select(name.alias("text_hash"), zero.alias("n_bytes"), "copies", "anchor", zero.alias("place"), "far", "near", "context"), "level")
    # What is there twice as a whole loses all of its strings.
    span = [F.col("text_hash"), F.col("n_bytes"), (F.col("place") - F.col("far")).alias("low"), (F.col("place") - F.col("near") + LENGTH).alias("high")]
    lost, size, level = [distinct.where("copies > 1").select(*span)], FAR + 1, distinct
    while level is not None:
        size = -(-size // 2)
        parts = scratch.table(split(level, size), f"parts{size}")
        if size == 1:
            counts = scratch.table(parts.groupBy("digest").agg(F.sum("copies").alias("total")).where("total > 1"), "counts1")
            lost.append(parts.join(counts, "digest", "left_semi").select(*span))
            break
        # Equal parts of different contexts: all lose all of their strings, and one goes on for them, to be met by others.
        once = parts.groupBy("anchor", "far", "near", F.sha2("context", 256).alias("digest")).agg(
            F.count("*").alias("n"), F.sum("copies").alias("copies"), *(F.first(c).alias(c) for c in (*KEY, "place", "context"))
        )
        once = scratch.table(once, f"once{size}")
        twice = once.where("n > 1").select("anchor", "far", "near", "digest")
        equal = parts.withColumn("digest", F.sha2("context", 256)).join(twice, ["anchor", "far", "near", "digest"], "left_semi")
        lost.append(scratch.table(equal.select(*span), f"equal{size}"))
        counts = scratch.table(once.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), f"counts{size}")
        few = once.join(counts.where(F.col("n") <= HOT), "anchor", "left_semi")
        lost.append(scratch.table(covered(few), f"lost{size}"))
        many = counts.where(F.col("n") > HOT)
        level = scratch.table(once.join(many, "anchor", "left_semi").drop("digest", "n"), f"level{size}") if len(many.take(1)) else None
    rows = lost[0]
    for more in lost[1:]:
        rows = rows.unionByName(more)
    rows = scratch.table(rows.groupBy(F.col("text_hash").alias("name")).agg(F.collect_set(F.struct("low", "high")).alias("lost")), "hot_lost")
    moved = F.transform("lost", lambda s: F.struct((F.col("place") + s["low"]).alias("low"), (F.col("place") + s["high"]).alias("high")))
    return found.select(*KEY, "place", name.alias("name")).join(rows, "name").select(*KEY, moved.alias("spans"))


def cut(texts: DataFrame) -> DataFrame:
    """KEY, n_removed, n_spans, kept_sha256, kept from texts(KEY, text, spans array<struct<low, high>>)."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tables:
            out = []
            for text, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans"), strict=True):
                low, high = (spans.values.field(k).to_numpy() for k in ("low", "high"))
                order = np.argsort(low)
                low, high = low[order], np.maximum.accumulate(high[order])
                first = np.ones(len(low), bool)
                first[1:] = low[1:] > high[:-1]
                begins, ends = low[first], high[np.append(np.flatnonzero(first)[1:], len(low)) - 1]
                kept = b"".join(text[i:j] for i, j in zip([0, *ends.tolist()], [*begins.tolist(), len(text)], strict=True))
                out.append((int((ends - begins).sum()), len(begins), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in KEY), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [*KEY, "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.select(*KEY, "text", "spans").mapInArrow(run, "text_hash binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def deduplicated(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """KEY, n_removed, n_spans, kept_sha256, kept for the texts of docs(doc_id, text) that lose bytes."""
    rows = keyed(docs)
    table = scratch.table(anchor_table(rows), "anchors")
    repeated = scratch.table(table.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1"), "repeated")
    touched = table.join(repeated, "anchor").groupBy(*KEY).agg(
        F.collect_set(F.when(F.col("total") <= HOT, F.col("anchor"))).alias("repeated"), F.collect_set(F.when(F.col("total") > HOT, F.col("anchor"))).alias("hot")
    )
    one = rows.where(F.col("n_bytes") >= LENGTH).groupBy(*KEY).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    texts = scratch.table(one.join(touched, KEY), "texts")
    spans = covered(occurrences(texts)).select(*KEY, F.array(F.struct("low", "high")).alias("spans"))
    if len(repeated.where(F.col("total") > HOT).take(1)):
        hot = occurrences(texts.where(F.size("hot") > 0).withColumn("repeated", F.col("hot")))
        spans = spans.unionByName(scratch.table(covered_hot(hot, scratch), "hot_spans"))
    spans = spans.groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return cut(texts.join(spans, KEY))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scratch = Scratch(spark, "suffix-dedup")
    found = scratch.table(deduplicated(docs, scratch).drop("kept"), "found")
    scratch.keep("found")
    rows = keyed(docs).select("doc_id", *KEY, F.sha2("text", 256).alias("whole_sha256"))
    none = F.lit(0).cast("long")
    done = rows.join(found, KEY, "left")
    return done.select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))
