"""Quality rules: word and line rules, and n-gram perplexity within bands of the language.

* Counts. N-grams are of ORDER bytes of UTF-8, exact as packed integers, so every script has its own. Tasks count what
  they read before anything is shuffled; the table of counts holds every n-gram of every whole text and grows with them.
* Model. Modified Kneser-Ney, as joins and aggregates of the count table: lower orders count distinct left neighbours,
  discounts follow each language's counts of counts. An n-gram of MIDDLE bytes or more that is there fewer than SEEN times
  gets no mass of its own but what shorter ones lend it, so that a document isn't judged by what only it says; of their
  three discounts, those for counts of 1 and 2 therefore act at the shorter orders only. The log
  probabilities are kept as sorted arrays of n-gram hashes, a row for each shard of the hash range; no task or driver
  holds more than a shard.
* Scores. Tasks pack the texts that they read into compressed blocks of about BLOCK bytes. A block asks each shard once
  for its distinct n-grams, and the answers meet the texts by block, from the same shuffle that the questions came from.
* Bands. A document is rejected beyond BELOW or ABOVE interquartile ranges of log2 perplexity of its language, taken over
  all documents that pass the base rule.

Defined results: a null text has no words and fails the base rule; null is a language of its own, apart from the empty
name; an empty table gives no rows; repeated rows are judged alike; other columns pass through where asked for, and a
name of OWN that they take gets an underscore in front. Texts of any length are worked on by slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, free_names, mix64, read, release, utf8_buffer
from quillstone.llm.spans import NOT_WHITE, further, owners, per_text, repeated, runs, span_numbers, windows
from quillstone.llm.token_counts import batches

#: Base rule.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Bytes of an n-gram; from MIDDLE bytes on it needs SEEN occurrences to have a mass of its own.
ORDER, MIDDLE, SEEN = 5, 3, 3
#: Interquartile ranges below the first and above the third quartile that are still within the band.
BELOW, ABOVE = 2.5, 2.5
#: The least interquartile range, in bits a byte, so that very uniform corpora aren't judged on noise.
LEAST_RANGE = 0.01
#: Bytes of text in a block, of a slice that is worked on at once, and of texts taken from Arrow together.
BLOCK, SLICE, BATCH_BYTES = 20_000_000, 1_000_000, 1_000_000
#: Distinct n-grams that a task holds before it hands on their counts, those that wait to be added up, and rows of a batch that it hands on.
HELD, WAITING, ROWS = 1_000_000, 250_000, 100_000
#: Least number of shards, hashes in a shard, and blocks a shard.
SHARDS, SHARD_HASHES, SHARD_BLOCKS = 64, 1_000_000, 1024

GRAM_BITS = 8 * ORDER
SYMBOL_BYTES = np.zeros(256, bool)
SYMBOL_BYTES[list(b"#*$%&|<>")] = True

OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "bits", "kept")


def base_columns(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of words, their characters, symbols, repeated lines and words in repeated 3-word windows."""
    texts = len(offsets) - 1
    inside = NOT_WHITE[data]
    starts, ends = runs(inside, offsets)
    text, own = owners(offsets, starts), span_numbers(data, starts, ends)
    marked = np.zeros(len(own), bool)
    if len(own) >= 3:
        at = np.flatnonzero(text[:-2] == text[2:])
        twice = at[repeated(text[at], windows(own, at))]
        del own, at
        for k in range(3):
            marked[twice + k] = True
    l_starts, l_ends = runs(data != 10, offsets)
    full = np.searchsorted(starts, l_ends) > np.searchsorted(ends, l_starts, "right")
    l_starts, l_ends = l_starts[full], l_ends[full]
    l_text = owners(offsets, l_starts)
    dup = further(l_text, span_numbers(data, l_starts, l_ends))
    return {
        "n_words": np.bincount(text, minlength=texts),
        "word_chars": per_text(offsets, inside & ((data & 0xC0) != 0x80)),
        "n_symbols": per_text(offsets, SYMBOL_BYTES[data]),
        "n_dup_lines": np.bincount(l_text[dup], minlength=texts),
        "n_repeat_words": np.bincount(text[marked], minlength=texts),
    }


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of positions, of SLICE bytes at most."""
    return ((i, min(i + SLICE, int(offsets[-1]))) for i in range(0, int(offsets[-1]), SLICE))


def grams(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> np.ndarray:
    """The n-gram that ends at each of the positions i to j, packed; a text begins after zero bytes."""
    out = data[i:j].astype(np.int64)
    starts = offsets[np.searchsorted(offsets, i - ORDER, "right") : np.searchsorted(offsets, j)]
    for k in range(1, ORDER):
        before = np.zeros(j - i, np.int64)
        low = max(i - k, 0)
        before[low + k - i :] = data[low : max(j - k, 0)]
        crossing = (starts[:, None] + np.arange(k)).reshape(-1) - i
        before[crossing[(crossing >= 0) & (crossing < j - i)]] = 0
        out += before << (8 * k)
    return out


def lang_name(lang: Column) -> Column:
    """A name for each language that is never null."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


class Tally:
    """Counts of integers, given piece by piece."""

    def __init__(self):
        self.keys, self.n, self.held, self.open = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, []

    def add(self, values: np.ndarray) -> None:
        found = pc.value_counts(pa.array(values))
        self.open.append((found.field("values").to_numpy(), found.field("counts").to_numpy()))
        self.held += len(found)
        if self.held > WAITING:
            self.settle()

    def settle(self) -> None:
        keys, n = (np.concatenate(x) for x in zip((self.keys, self.n), *self.open, strict=True))
        self.keys, place = np.unique(keys, return_inverse=True)
        self.n = np.bincount(place, weights=n, minlength=len(self.keys)).astype(np.int64)
        self.held, self.open = 0, []


def counted(docs: DataFrame) -> DataFrame:
    """lang (see lang_name), gram, n: how often every n-gram occurs in all texts."""

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        tally = Tally()

        def hand_on() -> Iterator[pa.RecordBatch]:
            tally.settle()
            langs = pa.array(list(codes), pa.string())
            for i in range(0, len(tally.keys), ROWS):
                keys = tally.keys[i : i + ROWS]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(keys >> GRAM_BITS)), pa.array(keys & ((1 << GRAM_BITS) - 1)), pa.array(tally.n[i : i + ROWS])], ["lang", "gram", "n"])

        for b in tables:
            of = np.array([codes.setdefault(x, len(codes)) for x in b.column("lang").to_pylist()], np.int64)
            for at, part in batches(b.column("text"), BATCH_BYTES):
                data, offsets = utf8_buffer(part)
                for i, j in slices(offsets):
                    tally.add(grams(data, offsets, i, j) | of[at + owners(offsets, np.arange(i, j))] << GRAM_BITS)
                if len(tally.keys) > HELD:
                    yield from hand_on()
                    tally = Tally()
        yield from hand_on()
        release()

    rows = docs.select(lang_name(F.col("lang")).alias("lang"), "text")
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def low_bytes(gram: Column, k: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (8 * k)) - 1))


def log_probabilities(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, gram, p: the interpolated modified Kneser-Ney probability of the last byte of each counted n-gram."""
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = scratch.table(levels[k + 1].groupBy("lang", low_bytes(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n")), f"level{k}")
    m = [F.greatest(F.count_if(F.col("n") == i), F.lit(1)).cast("double") for i in (1, 2, 3, 4)]
    y = m[0] / (m[0] + 2 * m[1])
    each = [F.least(F.greatest(i - (i + 1) * y * m[i] / m[i - 1], F.lit(0.05)), F.lit(i - 0.05 if i == 1 else i - 0.1)).alias(f"d{i}") for i in (1, 2, 3)]
    every = reduce(DataFrame.unionByName, [levels[k].select(F.lit(k).alias("k"), "lang", "n") for k in levels])
    # Written, so that Spark knows how small it is, and can split a language that most n-grams are of where it isn't.
    discounts = scratch.table(every.groupBy("k", "lang").agg(*each), "discounts")
    lower = None
    for k in range(1, ORDER + 1):
        rows = levels[k].join(discounts.where(F.col("k") == k).drop("k"), "lang").withColumn("context", F.shiftright("gram", 8))
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = F.greatest(F.col("n") - cut, F.lit(0.0))
        rows = rows.withColumn("own", F.when(F.col("n") >= SEEN, own).otherwise(0.0) if k >= MIDDLE else own)
        contexts = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("own").alias("mass"))
        rows = rows.join(contexts, ["lang", "context"])
        lent = 1 - F.col("mass") / F.col("total")
        if lower is None:
            p = F.col("own") / F.col("total") + lent / 256
        else:
            rows = rows.withColumn("short", low_bytes(F.col("gram"), k - 1)).join(lower, ["lang", "short"])
            p = F.col("own") / F.col("total") + lent * F.col("below")
        done = rows.select("lang", "gram", p.alias("p"))
        lower = done.select("lang", F.col("gram").alias("short"), F.col("p").alias("below"))
    return done


def hashed(langs: list[str], of: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """The hash of each n-gram of a language."""
    own = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)
    return mix64(mix64(gram.astype(np.uint64)) ^ own[of]) if len(langs) else np.zeros(0, np.uint64)


def shard_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def sorted_arrays(model: DataFrame, bits: int) -> DataFrame:
    """shard, hashes, log2s: sorted hashes as bytes, and log2 probabilities beside them, of model(lang, gram, p)."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tables:
            langs = b.column("lang").dictionary_encode()
            h = hashed(langs.dictionary.to_pylist(), langs.indices.to_numpy(), b.column("gram").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(h, bits)), pa.array(h.view(np.int64)), pa.array(np.log2(b.column("p").to_numpy()).astype(np.float32))], ["shard", "hash", "log2"])

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        h = table.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(h)
        return pa.table({"shard": [key[0].as_py()], "hashes": pa.array([h[order].tobytes()], pa.binary()), "log2s": pa.array([table.column("log2").to_numpy()[order].tobytes()], pa.binary())})

    rows = model.mapInArrow(run, "shard long, hash long, log2 float")
    return rows.groupBy("shard").applyInArrow(pack, "shard long, hashes binary, log2s binary")


def packed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """block, pack: the columns but text, renamed c0, c1, ..., with lang_ and text_, as compressed Arrow tables of about BLOCK bytes of text."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for b in held:
                out.write_batch(b)
        raw = sink.getvalue().to_pybytes()
        return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(raw).hexdigest()]), pa.array([raw], pa.binary())], ["block", "pack"])

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in tables:
            for at, part in batches(b.column("text_"), BLOCK):
                held.append(b.slice(at, len(part)))
                size += pc.sum(pc.binary_length(part)).as_py() or 0
                if size >= BLOCK:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)
        release()

    renamed = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns) if c.lower() != "text"]
    return docs.select(lang_name(F.col("lang")).alias("lang_"), F.col("text").alias("text_"), *renamed).mapInArrow(run, "block string, pack binary")


def unpacked(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Slices of a block, of about BATCH_BYTES of text."""
    for raw in table.column("pack"):
        for b in pa.ipc.open_stream(raw.as_buffer()):
            for at, part in batches(b.column("text_"), BATCH_BYTES):
                yield b.slice(at, len(part))


def coded(b: pa.RecordBatch) -> Iterator[tuple]:
    """For slices of a batch's bytes: languages, the n-grams with their language's number, and the text of each."""
    langs = b.column("lang_").dictionary_encode()
    of = langs.indices.to_numpy().astype(np.int64)
    data, offsets = utf8_buffer(b.column("text_"))
    for i, j in slices(offsets):
        text = owners(offsets, np.arange(i, j))
        yield langs.dictionary.to_pylist(), grams(data, offsets, i, j) | of[text] << GRAM_BITS, text


def key_hashes(langs: list[str], keys: np.ndarray) -> np.ndarray:
    return hashed(langs, keys >> GRAM_BITS, keys & ((1 << GRAM_BITS) - 1))


def block_hashes(table: pa.Table) -> np.ndarray:
    """The sorted distinct n-gram hashes of a block of texts."""
    found, held = [np.zeros(0, np.uint64)], 0
    for b in unpacked(table):
        for langs, keys, _ in coded(b):
            found.append(key_hashes(langs, pc.unique(pa.array(keys)).to_numpy()))
            held += len(found[-1])
        if held > WAITING:
            found, held = [np.unique(np.concatenate(found))], 0
    return np.unique(np.concatenate(found))


def questions(blocks: DataFrame, bits: int) -> DataFrame:
    """block, shard, hashes: what each block asks of each shard."""

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        h = block_hashes(table)
        cuts = np.searchsorted(shard_of(h, bits), np.arange((1 << bits) + 1))
        some = np.flatnonzero(np.diff(cuts))
        own = [h[cuts[s] : cuts[s + 1]].tobytes() for s in some]
        release()
        return pa.table({"block": pa.array([key[0].as_py()] * len(some), pa.string()), "shard": pa.array(some.astype(np.int64)), "hashes": pa.array(own, pa.binary())})

    return blocks.groupBy("block").applyInArrow(ask, "block string, shard long, hashes binary")


def answers(asked: DataFrame, arrays: DataFrame) -> DataFrame:
    """block, shard, log2s: the log2 probabilities of the hashes asked for. Each shard's arrays come before its questions."""

    def look_up(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = values = None
        for b in tables:
            out = []
            for shard, block, h, v in zip(*(b.column(c).to_pylist() for c in ("shard", "block", "hashes", "log2s")), strict=True):
                h = np.frombuffer(h, np.uint64)
                if block is None:
                    hashes, values = h, np.frombuffer(v, np.float32)
                else:
                    out.append((block, shard, values[np.searchsorted(hashes, h)].tobytes()))  # all n-grams of all texts are there
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.binary()), strict=True)], ["block", "shard", "log2s"])

    none = F.lit(None)
    both = arrays.select("shard", none.cast("string").alias("block"), "hashes", "log2s").unionByName(asked.select("shard", "block", "hashes", none.cast("binary").alias("log2s")))
    both = both.repartition("shard").sortWithinPartitions("shard", F.col("block").asc_nulls_first())
    return both.mapInArrow(look_up, "block string, shard long, log2s binary")


def scored(docs: DataFrame, columns: list[str], scratch: Scratch) -> DataFrame:
    """The columns asked for, then all of OWN but the verdict, then the language's name, under a name that is free."""
    counts = scratch.table(counted(docs), "counts")
    size = counts.agg(F.count("*").alias("grams"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes")).first()
    bits = int(max(SHARDS, size["grams"] // SHARD_HASHES, size["bytes"] // (BLOCK * SHARD_BLOCKS)) - 1).bit_length()
    arrays = scratch.table(sorted_arrays(log_probabilities(counts, scratch), bits), "model")
    own = free_names(docs.select(*columns), *OWN)
    # Both uses take all columns of this shuffle, so that Spark reuses it.
    blocks = packed(docs, columns).repartition(max(1, 2 * size["bytes"] // BLOCK), "block")
    known = answers(questions(blocks, bits), arrays)
    kinds = ["long"] * 5 + ["boolean", "double"]
    schema = ", ".join([f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns)] + [f"`{n}` {k}" for n, k in zip(own, kinds, strict=False)] + ["lang_ string"])

    def judge(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        hashes = block_hashes(table)
        order = np.argsort(found.column("shard").to_numpy())
        log2s = found.column("log2s").to_pylist()
        log2s = np.frombuffer(b"".join(log2s[i] for i in order), np.float32)
        out = []
        for b in unpacked(table):
            total = np.zeros(len(b))
            for langs, keys, text in coded(b):
                each = pa.array(keys).dictionary_encode()
                values = log2s[np.searchsorted(hashes, key_hashes(langs, each.dictionary.to_numpy()))]
                total += np.bincount(text, weights=values[each.indices.to_numpy()], minlength=len(b))
            data, offsets = utf8_buffer(b.column("text_"))
            base = base_columns(data, offsets)
            failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED_PERCENT * base["n_words"])
            sizes = np.diff(offsets)
            kept = [b.column("text_" if c.lower() == "text" else f"c{i}") for i, c in enumerate(columns)]
            found_here = [pa.array(base[n].astype(np.int64)) for n in OWN[:5]] + [pa.array(failed), pa.array(-total / np.maximum(sizes, 1), mask=sizes == 0)]
            out.append(pa.RecordBatch.from_arrays([*kept, *found_here, b.column("lang_")], [*(f"c{i}" for i in range(len(columns))), *own[:-1], "lang_"]))
        release()
        return pa.Table.from_batches(out)

    done = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(judge, schema)
    return done.toDF(*columns, *own[:-1], *free_names(docs.select(*columns), "lang_"))


def quality_rules(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns asked for with the rules' counts and verdicts, a row for each document of docs(lang, text, ...)."""
    scratch = Scratch(docs.sparkSession, "quality-rules")
    own = free_names(docs.select(*columns), *OWN)
    failed, bits, kept = own[5:]
    (lang_,) = free_names(docs.select(*columns), "lang_")
    done = scratch.table(scored(docs, columns, scratch), "scored")
    scratch.keep("scored")
    q = F.percentile_approx(bits, F.array(F.lit(0.25), F.lit(0.75)), F.lit(10000))
    width = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST_RANGE))
    bands = done.where(~F.col(failed) & F.col(bits).isNotNull()).groupBy(lang_).agg(q.alias("q"))
    low_, high_ = free_names(done, "low_", "high_")
    bands = scratch.table(bands.select(lang_, (F.col("q")[0] - BELOW * width).alias(low_), (F.col("q")[1] + ABOVE * width).alias(high_)), "bands")
    within = F.coalesce(F.col(bits).between(F.col(low_), F.col(high_)), F.lit(True))
    return done.join(bands, lang_, "left").withColumn(kept, ~F.col(failed) & within).select(*columns, *own)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality_rules(docs, ["doc_id"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with their columns."""
    kept = free_names(docs, *OWN)[-1]
    return quality_rules(docs, docs.columns).where(kept).select(*docs.columns)
