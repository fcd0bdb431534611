"""Vector codes: product quantisation whose nearest entries are found by annular norm pruning.

A codebook's entries are sorted by norm. A part of a vector first meets the entry of the nearest norm; by the triangle
inequality no entry can be as near as the best so far unless its norm differs from the part's by at most that distance,
so the interval of norms allowed is found by binary search, cut again after the PROBES entries at its middle, and the
annulus that is left is evaluated exactly, edges included. All distances are integers.

Codebooks are PARTS x ENTRIES x the length of a part: they alone go to the driver and to all tasks. Each round reads the
vectors once; tasks hand on one row of sums and counts for each entry they met.

Defined results: a vector that is null, or holds a null or non-finite component, is dropped, as is one of another length
than the kept one of the smallest vec_id. Components are cut off at +-LARGEST, so that sums stay exact. A length that
PARTS doesn't divide is filled up with zeros; vectors without components have the code of the first entry and no error.
Null vec_ids are encoded but start no entry. Rows of equal vec_id are told apart by their components; equal entries
yield to the lower index. Fewer than ENTRIES vectors make as many entries, an empty table no rows and no codebook; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, read, release

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Steps in 1.0 of a component.
SCALE = 256
#: The largest component in steps: (2 * LARGEST) ** 2 times a part's length stays exact.
LARGEST = 1 << 27
#: Entries around the nearest norm that are met before the annulus is cut.
PROBES = 4
#: Vectors, and meetings of a part and an entry, that are worked on at once.
ROWS, MEETINGS = 4096, 1 << 20


def whole(vector: Column) -> Column:
    """Whether a vector has only finite components."""
    fails = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~fails


def steps(flat: np.ndarray, length: int, parts: int) -> np.ndarray:
    """Vectors, one after another, as integers [row, part, position]."""
    x = np.clip(np.floor(flat.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64).reshape(-1, length)
    return np.pad(x, ((0, 0), (0, -length % parts))).reshape(len(x), parts, -(-length // parts))


def squared(x: np.ndarray) -> np.ndarray:
    return np.einsum("...i,...i->...", x, x)


class Annuli:
    """The entries of one part's codebook, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        self.norms = np.sqrt(squared(entries).astype(np.float64))
        self.order = np.argsort(self.norms, kind="stable")
        self.norms, self.entries = self.norms[self.order], entries[self.order]

    def allowed(self, norms: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of sorted entries whose norms the best squared distances allow, edges and rounding included."""
        reach = np.sqrt(best.astype(np.float64))
        slack = 1e-9 * (norms + reach) + 1e-9
        return np.searchsorted(self.norms, norms - reach - slack, "left"), np.searchsorted(self.norms, norms + reach + slack, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry of each row, the lower of equal ones, and its squared distance."""
        norms = np.sqrt(squared(x).astype(np.float64))
        at = np.minimum(np.searchsorted(self.norms, norms), len(self.norms) - 1)
        best = squared(x - self.entries[at])
        for step in range(1, PROBES):
            near = np.clip(at + (step + 1) // 2 * (-1 if step % 2 else 1), 0, len(self.norms) - 1)
            best = np.minimum(best, squared(x - self.entries[near]))
        low, high = self.allowed(norms, best)
        index, ends = np.empty(len(x), np.int64), np.cumsum(high - low)
        i = 0
        while i < len(x):
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + MEETINGS, "right")))
            sizes = (high - low)[i:j]
            starts = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(i, j), sizes)
            entry = np.arange(sizes.sum()) - np.repeat(starts - low[i:j], sizes)
            far = squared(x[row] - self.entries[entry])
            best[i:j] = np.minimum.reduceat(far, starts)  # an annulus has the best so far at least
            index[i:j] = np.minimum.reduceat(np.where(far == best[row], self.order[entry], len(self.order)), starts)
            i = j
        return index, best


def coded(x: np.ndarray, books: list[Annuli]) -> tuple[np.ndarray, np.ndarray]:
    """The indexes [row, part] of the nearest entries and the squared distances."""
    found = [book.nearest(x[:, p]) for p, book in enumerate(books)]
    return np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)


def rows_of(table: pa.RecordBatch, length: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Slices of a batch of whole vectors: where they begin, and their integers."""
    for i in range(0, len(table), ROWS):
        some = table.column("embedding").slice(i, ROWS)
        if length == 0:
            yield i, np.zeros((len(some), parts, 0), np.int64)
        else:
            yield i, steps(pc.list_flatten(some).to_numpy(zero_copy_only=False), length, parts)


def refined(vectors: DataFrame, books: np.ndarray, length: int) -> np.ndarray:
    """The codebooks [part, entry, position] after one round."""
    parts, entries, width = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def add_up(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(b) for b in shared.value]
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for table in tables:
            for _, x in rows_of(table, length, parts):
                cell = (coded(x, annuli)[0] + np.arange(parts) * entries).reshape(-1)
                np.add.at(sums, cell, x.reshape(len(cell), width))
                counts += np.bincount(cell, minlength=len(counts))
        met = np.flatnonzero(counts)
        cells = np.repeat(met, width + 1)
        place = np.tile(np.arange(-1, width), len(met))
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(place), pa.array(np.column_stack([counts, sums])[met].reshape(-1))], ["cell", "place", "total"])

    found = vectors.select("embedding").mapInArrow(add_up, "cell long, place long, total long").groupBy("cell", "place").agg(F.sum("total").alias("total"))
    out = books.reshape(parts * entries, width).copy()
    totals = {(r.cell, r.place): r.total for r in found.collect()}  # at most one for each number of the codebooks
    for cell, place in totals:
        if place >= 0:
            out[cell, place] = totals[cell, place] // totals[cell, -1]
    return out.reshape(books.shape)


def vector_codes(vectors: DataFrame, scratch: Scratch, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """vec_id, label, codes array<int>, error of the kept vectors(vec_id, embedding, label), and the codebooks [part, entry, position]."""
    kept = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where(whole(F.col("embedding")))
    first = kept.where("vec_id is not null").orderBy("vec_id", "embedding").select("embedding").limit(1).first()
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, label {vectors.schema['label'].dataType.simpleString()}, codes array<int>, error long"
    if first is None:
        return vectors.sparkSession.createDataFrame([], schema), None
    length = len(first.embedding)
    kept = kept.where(F.size("embedding") == length)
    start = kept.where("vec_id is not null").orderBy("vec_id", "embedding").limit(entries).select("embedding").collect()
    flat = np.array([r.embedding for r in start], np.float64).reshape(-1)
    books = (steps(flat, length, parts) if length else np.zeros((len(start), parts, 0), np.int64)).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = refined(kept, books, length)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def encode(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(b) for b in shared.value]
        for table in tables:
            for i, x in rows_of(table, length, parts):
                codes, errors = coded(x, annuli)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * parts), pa.array(codes.reshape(-1).astype(np.int32)))
                own = [table.column(c).slice(i, len(x)) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*own, lists, pa.array(errors.sum(axis=1))], ["vec_id", "label", "codes", "error"])
        release()

    return scratch.table(kept.mapInArrow(encode, schema), "codes"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "vector-codes")
    done, books = vector_codes(read(spark, sf_dir, "embeddings"), scratch)
    digest = hashlib.sha256(b"" if books is None else ",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    # Written, so that Spark knows how small it is, and can split a label that most vectors have where it isn't.
    totals = scratch.table(done.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return done.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round_sql(n: int) -> str:
    """Assignments by the codebooks book{n}, and the codebooks after them, which keep what no part chose."""
    return f"""
    near{n} AS (SELECT row, part, arg_min(entry, far * 64 + entry) AS entry, min(far) AS far FROM (
        SELECT p.row, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS far FROM parts p JOIN book{n} b ON p.part = b.part AND p.place = b.place GROUP BY ALL) GROUP BY row, part),
    book{n + 1} AS (SELECT b.part, b.entry, b.place, coalesce(m.x, b.x) AS x FROM book{n} b LEFT JOIN (
        SELECT p.part, n.entry, p.place, CAST(floor(sum(p.x) / count(*)) AS BIGINT) AS x FROM parts p JOIN near{n} n USING (row, part) GROUP BY ALL) m USING (part, entry, place)),"""


OP13_SQL = f"""
WITH kept AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS row FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS (SELECT row, (i - 1) // 4 AS part, (i - 1) % 4 AS place, CAST(floor(256 * embedding[i]) AS BIGINT) AS x
        FROM kept, range(1, 65) t(i)),
    book0 AS (SELECT part, row AS entry, place, x FROM parts WHERE row < 64),
    {_round_sql(0)}{_round_sql(1)}{_round_sql(2)}
    done AS (SELECT row, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM near2 GROUP BY row),
    digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM done JOIN kept USING (row), digest
"""
