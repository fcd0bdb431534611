"""SentencePiece encoding and decoding with a distinct-chunk table.

In a model whose pieces hold no white-space marker after another character, no merge crosses from one marked word into
the next. So a text is cut before its markers, distinct marked words are segmented once by the sentencepiece library, and
the ids are joined back by position. Texts with runs of markers, and those that begin or end with one, are segmented
whole. Decoding is the library's own, over the ids of a batch.

Spark counts the words of all texts, and the COMMON most frequent ones of at most LONGEST bytes are segmented once for the
corpus; their table, which has that bound, is broadcast. Of the rest, each distinct word is segmented once a batch: a
table of all words would need every word occurrence to be joined to it across the cluster, far more data than the texts.

A model with pieces that cross markers, another normalisation, or no dummy prefix is run on whole texts.

Defined results: a null text is empty; an empty text has the begin and end ids only; an empty table gives no rows;
repeated rows each have a result; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quillstone.llm.common import free_names, read, release
from quillstone.llm.token_counts import batches

MARK = "▁"
BATCH_BYTES = 4_000_000
#: Words in the table of the corpus, and their greatest length in bytes.
COMMON, LONGEST = 100_000, 64
#: Distinct words that a task counts before it hands them on, and the least count there that is worth a row.
HELD, LEAST = 1_000_000, 2
#: What makes a text one that is segmented whole. The library puts a marker before a text that is not empty, and so before
#: each word that it gets alone. Pieces may hold several markers in front, so a run of them is no place to cut.
HARD = "[ ▁][ ▁]|^[ ▁]|[ ▁]$|▁"


def chunkable(processor) -> bool:
    """Whether the model's pieces and normaliser allow cutting before markers."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(processor.serialized_model_proto())
    n = model.normalizer_spec
    plain = not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
    user = any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in model.pieces)
    return plain and not user and not any(MARK in p.piece.lstrip(MARK) for p in model.pieces)


class Codec:
    """Encodes and decodes batches of texts as the library does, with begin and end ids."""

    def __init__(self, path: str, table: tuple[pa.Array, pa.Array] | None = None):
        """table: words of the corpus and the ids of each."""
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunked = chunkable(self.sp)
        self.words, self.ids = table or (pa.array([], pa.string()), pa.array([], pa.list_(pa.int32())))

    def encode(self, texts: pa.Array) -> pa.Array:
        """The list of ids of each text."""
        texts = pc.fill_null(texts, "")
        if not self.chunked:
            return pa.array(self.sp.encode(texts.to_pylist(), add_bos=True, add_eos=True, num_threads=1), pa.list_(pa.int32()))
        hard = pc.match_substring_regex(texts, HARD).to_numpy(zero_copy_only=False)
        plain, rest = np.flatnonzero(~hard), np.flatnonzero(hard)
        whole = self.sp.encode(texts.take(pa.array(rest)).to_pylist(), add_bos=True, add_eos=True, num_threads=1)
        both = pa.concat_arrays([self._by_word(pc.split_pattern(texts.take(pa.array(plain)), " ")), pa.array(whole, pa.list_(pa.int32()))])
        return both.take(pa.array(np.argsort(np.concatenate([plain, rest]), kind="stable")))

    def _by_word(self, parts: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(parts).dictionary_encode()
        table = self._segmented(coded.dictionary)
        n = pc.list_value_length(table).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = table.flatten().to_numpy()
        codes = coded.indices.to_numpy()
        each = n[codes]
        begins = np.cumsum(n) - n
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(begins[codes] - (ends - each), each) + np.arange(total)]
        # With begin and end ids around each text.
        word_ends = np.cumsum(sizes)
        text_ends = np.concatenate([[0], ends])[word_ends]
        text_sizes = np.diff(text_ends, prepend=0)
        offsets = np.concatenate([[0], np.cumsum(text_sizes + 2)])
        whole = np.empty(total + 2 * len(sizes), np.int32)
        inner = np.ones(len(whole), bool)
        inner[offsets[:-1]] = inner[offsets[1:] - 1] = False
        whole[inner], whole[offsets[:-1]], whole[offsets[1:] - 1] = ids, self.sp.bos_id(), self.sp.eos_id()
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(whole))

    def _segmented(self, words: pa.Array) -> pa.Array:
        """The ids of each distinct word: from the table, or segmented now. Each gets the space before it from the library."""
        place = pc.index_in(words, value_set=self.words)
        new = words.filter(place.is_null())
        own = pa.array(self.sp.encode(new.to_pylist(), num_threads=1), pa.list_(pa.int32()))
        at = place.to_numpy(zero_copy_only=False).copy()
        at[np.isnan(at)] = len(self.words) + np.arange(len(new))
        return pa.concat_arrays([self.ids, own]).take(pa.array(at.astype(np.int64)))

    def decode(self, ids: pa.Array) -> list[str]:
        flat, ends = ids.values.to_numpy().tolist(), ids.offsets.to_pylist()
        return self.sp.decode([flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)], num_threads=1)


def common_words(docs: DataFrame, path: str) -> tuple[pa.Array, pa.Array] | None:
    """The most frequent marked words of docs(text), segmented once, by tasks; None for a model that is run on whole texts."""
    if not Codec(path).chunked:
        return None

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})

        def known() -> Iterator[pa.RecordBatch]:
            return held.filter(pc.greater_equal(held.column("n"), LEAST)).to_batches()

        for b in tables:
            for _, part in batches(b.column("text"), BATCH_BYTES):
                part = pc.fill_null(part, "")
                part = part.filter(pc.invert(pc.match_substring_regex(part, HARD)))
                found = pc.value_counts(pc.list_flatten(pc.split_pattern(part, " ")))
                found = pa.table({"word": found.field("values"), "n": found.field("counts")})
                found = found.filter(pc.less_equal(pc.binary_length(found.column("word")), LONGEST))
                held = pa.concat_tables([held, found]).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
                if len(held) > HELD:
                    yield from known()
                    held = held.slice(0, 0)
        yield from known()
        release()

    def segment(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for b in tables:
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(codec.sp.encode(b.column("word").to_pylist(), num_threads=1), pa.list_(pa.int32()))], ["word", "ids"])

    found = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(COMMON)
    table = found.select("word").repartition("word").mapInArrow(segment, "word string, ids array<int>").toArrow()
    return table.column("word").combine_chunks(), table.column("ids").combine_chunks()


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """docs with ids array<int> and decoded string (with an underscore in front, where the name is taken)."""
    own = free_names(docs, "ids", "decoded")
    shared = docs.sparkSession.sparkContext.broadcast(common_words(docs, path))
    schema = StructType([*docs.schema.fields, StructField(own[0], ArrayType(IntegerType())), StructField(own[1], StringType())])

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, shared.value)
        for b in tables:
            for at, part in batches(b.column("text"), BATCH_BYTES):
                ids = codec.encode(part)
                rest = b.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([*rest.columns, ids, pa.array(codec.decode(ids), pa.string())], [*b.schema.names, *own])
        del codec
        release()

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_tokens, ids_sha256, decoded_sha256; ids and texts stay in the task."""
    shared = docs.sparkSession.sparkContext.broadcast(common_words(docs, path))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, shared.value)
        for b in tables:
            for at, part in batches(b.column("text"), BATCH_BYTES):
                ids = codec.encode(part)
                raw, ends = ids.values.to_numpy().astype("<u4").tobytes(), ids.offsets.to_numpy() * 4
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(at, len(part)),
                        pc.list_value_length(ids).cast(pa.int64()),
                        pa.array([hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(ends[:-1], ends[1:], strict=True)]),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in codec.decode(ids)]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        del codec
        release()

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and decoded of each document."""
    import public_tokenizers

    done = encode_decode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")
