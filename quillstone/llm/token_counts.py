"""Token counts: a digest cache.

Each text has a content digest; (content digest, tokenizer digest) is looked up in a table of stored counts. Only the
distinct texts that are not in it are encoded, and their counts are appended to it. The normalised content is the text
itself with null as empty: anything that changes the text more (case, white space, Unicode forms) changes its tokens.

A text to encode is cut at single spaces between other characters, where byte-level pre-tokenizers cut in any case; each
distinct piece of a batch is encoded once by the tokenizers library and the counts are summed by position.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated texts share one cache row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, read

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
#: Tokens beyond which a text is over the limit.
LIMIT = 512
#: Texts of about so many bytes are encoded together.
BATCH_BYTES = 32_000_000
#: Pieces encoded by one call.
PIECES = 20_000


def tokenizer_digest(path: str) -> str:
    """Of the vocabulary file and the library's version: counts are reused only if both are the same."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"|tokenizers " + tokenizers.__version__.encode()).hexdigest()


def batches(column: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """Slices of up to about that many bytes, at least one row each, and where they begin."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield at, column.slice(at, to - at)
        at = to


#: Where a space is next to other white space, as Arrow's and Python's expressions; there the cut needs a look at both sides.
BESIDE_WHITE = r"[\t-\r\x1c-\x20\x{85}\p{Z}] | [\t-\r\x1c-\x20\x{85}\p{Z}]"
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def can_cut(tokenizer) -> bool:
    """Whether tokens never cross a single space between other characters: byte-level pre-tokenization, no odd added tokens."""
    spec = json.loads(tokenizer.to_str())
    own = spec.get("pre_tokenizer") or {}
    odd = [t for t in spec.get("added_tokens") or () if " " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"]]
    return own.get("type") == "ByteLevel" and own.get("use_regex", True) and not own.get("add_prefix_space") and spec.get("normalizer") is None and not odd


def lengths(tokenizer, pieces: list[str]) -> list[int]:
    """Tokens of each piece. The library's results are large, so few are held at a time."""
    return [len(e) for i in range(0, len(pieces), PIECES) for e in tokenizer.encode_batch_fast(pieces[i : i + PIECES], add_special_tokens=False)]


def count_tokens(texts: pa.Array, tokenizer, cut: bool = True) -> np.ndarray:
    """Tokens of each text. With cut, each distinct piece with the space before it is encoded once."""
    texts = pc.fill_null(texts, "")
    if not cut:
        return np.array(lengths(tokenizer, texts.to_pylist()), np.int64)
    counts = np.zeros(len(texts), np.int64)
    beside = pc.match_substring_regex(texts, BESIDE_WHITE).to_numpy(zero_copy_only=False)
    for rows, hard in ((np.flatnonzero(~beside), False), (np.flatnonzero(beside), True)):
        if not len(rows):
            continue
        chosen = texts.take(pa.array(rows))
        parts = pa.array([SAFE_CUT.split(x) for x in chosen.to_pylist()], pa.list_(pa.string())) if hard else pc.split_pattern(chosen, " ")
        sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        coded = pc.list_flatten(parts).dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        each = np.array(lengths(tokenizer, [f" {w}" for w in distinct]), np.int64)[codes]
        first, place = np.unique(codes[starts], return_inverse=True)
        each[starts] = np.array(lengths(tokenizer, [distinct[i] for i in first]), np.int64)[place]
        counts[rows] = np.add.reduceat(each, starts)
    return counts


def encode_misses(misses: DataFrame, path: str, digest: str) -> DataFrame:
    """Cache rows for misses(content_digest, text)."""

    def encode(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        cut = can_cut(tokenizer)
        for b in tables:
            for at, part in batches(b.column("text"), BATCH_BYTES):
                yield pa.RecordBatch.from_arrays(
                    [b.column("content_digest").slice(at, len(part)), pa.array([digest] * len(part), pa.string()), pa.array(count_tokens(part, tokenizer, cut))],
                    ["content_digest", "tokenizer_digest", "n_tokens"],
                )

    return misses.mapInArrow(encode, CACHE_SCHEMA)


def count_with_cache(docs: DataFrame, path: str, cache_path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of docs(doc_id, text); what the cache at cache_path lacked is appended to it."""
    spark = docs.sparkSession
    digest = tokenizer_digest(path)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", "text").withColumns({"n_bytes": F.octet_length(text).cast("long"), "content_digest": F.unhex(F.sha2(text, 256))})
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
        known = cache.where(F.col("tokenizer_digest") == digest).select("content_digest").distinct()
        wanted = keyed.join(known, "content_digest", "left_anti")
    except AnalysisException:  # there is no cache yet
        wanted = keyed
    misses = wanted.groupBy("content_digest").agg(F.first(text).alias("text"))
    encode_misses(misses, path, digest).write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == digest)
    counts = counts.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))  # two writers may have appended the same text
    # Written, so that the join's both sides are dealt out for it alone and AQE can split a text that very many rows have.
    counts = Scratch(spark, "token-counts").table(counts, "counts")
    return keyed.drop("text").join(counts, "content_digest", "left").drop("content_digest")


def op8_token_counts(spark: SparkSession, sf_dir: str, cache_path: str | None = None) -> DataFrame:
    """With a cache of its own for each call, so that its figures are those of a first run."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = count_with_cache(docs, public_tokenizers.path("byte_bpe_50k.json"), cache_path or f"{Scratch(spark, 'token-cache').base}/counts")
    return done.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
